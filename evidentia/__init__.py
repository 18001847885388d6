"""Evidence analytics on PySpark: ingestion, ranking, verification and evaluation as DataFrame operators."""
