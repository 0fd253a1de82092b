"""textlode: ID-scoped document indexing and retrieval on Spark DataFrames."""
