"""anomalypool: a PySpark-native engine for pools of labelled univariate time series."""
