"""A PySpark engine for text correction analytics at corpus scale."""
