"""Topic mining and clustering on Spark: every step is a DataFrame -> DataFrame function."""
