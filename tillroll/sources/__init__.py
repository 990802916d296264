"""Reading raw files, writing tables, and the synthetic binding used for tests."""
