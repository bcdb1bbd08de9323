"""Column expressions. Everything here is built from pyspark.sql.functions."""
