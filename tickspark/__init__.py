"""Market-data analytics as PySpark DataFrame operators."""
