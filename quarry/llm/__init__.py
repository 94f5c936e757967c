"""Training-data operators: every module here is self-contained and nothing else in the library imports it."""
