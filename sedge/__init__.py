"""A PySpark-native engine for document corpora and the training data made of them."""
