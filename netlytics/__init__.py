"""Network analytics and corpus preparation on PySpark."""
