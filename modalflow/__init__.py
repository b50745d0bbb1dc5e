"""A PySpark-native engine for multivariate time series and entity panels."""
