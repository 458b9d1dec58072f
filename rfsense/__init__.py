"""rfsense: Spark analytics for per-device streams of array-valued radio packets."""
