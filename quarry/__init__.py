"""A PySpark-native engine for object-storage metadata, and operators for training data in `llm`."""
