"""brindle: a PySpark-native analytics engine for scan, filter, project and aggregate workloads."""
