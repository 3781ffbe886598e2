"""Repository intelligence on Spark: tables, operators and queries as DataFrame plans."""
