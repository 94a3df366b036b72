"""voltloom: Spark-native analytics over electricity-meter time series."""
