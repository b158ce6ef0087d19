"""skeinflow: a PySpark-native analytics engine for medallion pipelines over market and text data."""
