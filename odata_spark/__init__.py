"""OData v4 queries over Spark DataFrames."""
