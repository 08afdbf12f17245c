"""careerloom: a PySpark-native labour-market and occupation analytics engine."""
