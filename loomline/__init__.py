"""loomline: a PySpark-native analytics engine for media catalogues and timed dialogue."""
