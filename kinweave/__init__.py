"""kinweave: record linkage, record quality and corpus preparation on PySpark."""
