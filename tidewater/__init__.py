"""tidewater: a Spark-first analytics engine for multi-asset time series."""
