"""Panel forecasting and time-series analytics as lazy Spark DataFrame operators."""
