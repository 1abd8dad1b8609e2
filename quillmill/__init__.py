"""quillmill: a PySpark-native engine for corpus curation, retrieval and evaluation."""

__version__ = "0.1.0"
