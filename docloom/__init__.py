"""docloom: a document analytics and retrieval engine on PySpark DataFrames."""
