"""Column -> Column helpers built from Spark SQL functions."""
