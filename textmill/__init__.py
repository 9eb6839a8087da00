"""PySpark-native preparation and evaluation of language-model training text."""
