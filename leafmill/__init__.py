"""A Spark-native engine for documents: PDF and fax analytics, and training-data operators."""
