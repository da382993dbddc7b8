"""Column expressions and the SQL text of kernels that Spark SQL lacks."""
