"""tidemark: a PySpark-native engine for ad-event ledgers and training-data tables."""
