"""Distributed building blocks: ordering, joins, cohorts, activity, features, sampling, profiles."""
