"""vialworks: a PySpark-native analytics engine for safety-sheet catalogues."""
