"""Reference answers in SQL, written apart from the Spark code."""
