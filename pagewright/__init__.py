"""pagewright: a PySpark-native engine for corpora of extracted documents."""
