"""A PySpark engine for building, measuring and comparing labelled text datasets."""
