"""A PySpark-native analytics engine: declared models, validated builders, lazy DataFrames."""
