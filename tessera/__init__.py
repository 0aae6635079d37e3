"""tessera: a PySpark-native engine for knowledge retrieval and data processing."""
