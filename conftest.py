"""Makes the repository root importable for the tests."""
