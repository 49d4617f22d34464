"""quern: a PySpark-native engine for messy, multi-source price panels and text corpora."""
