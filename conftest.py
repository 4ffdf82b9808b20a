"""Makes the repository root importable from the tests."""
