"""Schema-inferring, deduplicating bulk ingestion and its analytics on Spark."""
