"""folioforge: document analytics on Spark."""
