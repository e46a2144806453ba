"""MLlib estimators, search, evaluation and importances."""
