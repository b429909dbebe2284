"""reportlake: a PySpark-native engine for annotating and auditing free-text reports."""
