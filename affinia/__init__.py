"""affinia: similarity-driven evidence analytics on PySpark."""
