"""citespan: a Spark-native index of source repositories and document corpora, answering with path:line evidence."""

__version__ = "0.1.0"
