"""tessera: a PySpark-native engine for code and document retrieval."""
