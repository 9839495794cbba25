"""skyframe: sky-catalog analytics expressed as PySpark DataFrame operators."""
