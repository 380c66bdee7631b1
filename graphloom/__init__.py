"""graphloom: a PySpark-native code-graph analytics engine."""
