"""kelpie: a PySpark-native engine for document retrieval and knowledge graphs."""
