"""Gristmill: a PySpark-native engine for scanning text corpora and analysing scan history."""
