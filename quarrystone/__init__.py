"""Quarrystone: a PySpark-native engine for evidence-grounded product catalogues."""
