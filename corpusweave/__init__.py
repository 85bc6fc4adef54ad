"""corpusweave: a PySpark-native engine for document corpora and event ledgers."""
