"""Training-data operators: a self-contained subpackage nothing else in the library imports."""
