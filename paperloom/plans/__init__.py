"""End-to-end jobs, views over the test tables, and the query registry."""
