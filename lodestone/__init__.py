"""lodestone: evidence-backed knowledge analytics and corpus preparation on PySpark."""
