"""A PySpark engine that finds, decides on, removes and verifies what documents expose."""
