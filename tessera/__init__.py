"""Evidence retrieval, safety decisions and corpus preparation on Spark."""
