"""Column functions, UDFs and table functions."""
