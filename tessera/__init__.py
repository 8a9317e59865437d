"""A PySpark engine for the data work behind machine-learning and agent workflows."""
