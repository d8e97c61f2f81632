"""Job-market analytics as PySpark DataFrame operators."""
