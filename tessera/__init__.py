"""Tessera: point-in-time event analytics expressed as Spark DataFrame plans."""
