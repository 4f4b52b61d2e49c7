"""Time-bucketed vector analytics expressed as PySpark DataFrame plans."""
