"""civicspark: a PySpark-native analytics engine for public-record corpora."""
