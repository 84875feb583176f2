"""tidewatch: Spark-native analytics for operational run monitoring."""
