"""Reading and writing entity tables, and the entity views over the test tables."""
