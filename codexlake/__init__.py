"""codexlake: a Spark-native engine for annotated-text corpora and the systems that produce them."""

__version__ = "0.1.0"
