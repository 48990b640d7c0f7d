"""lithograph: code-entity analytics and training-data operators on PySpark."""
