"""PySpark-native engine for scripted source rewriting."""
