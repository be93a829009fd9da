"""tidemark: catalog analytics and corpus preparation as Spark DataFrames."""
