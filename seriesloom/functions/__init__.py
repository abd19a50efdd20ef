"""Column builders: the numeric conventions of the library in one place."""
