"""clinflow: a PySpark-native engine for time-anchored event tables."""
