"""Media catalog analytics as PySpark DataFrame operators."""
