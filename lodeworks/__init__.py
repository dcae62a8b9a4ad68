"""lodeworks: retrieval, graph, history and corpus analytics on plain PySpark DataFrames."""
