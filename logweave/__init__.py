"""A PySpark-native engine that rebuilds, checks and streams distributed logs."""
