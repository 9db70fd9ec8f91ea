"""scriptoria: a Spark-native engine for analysing text, web-page and source-code corpora."""

__version__ = "0.1.0"
