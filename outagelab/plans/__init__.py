"""User-level jobs composed from the operators: cohorts, variables, activity, preparation, models."""
