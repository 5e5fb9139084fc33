"""quillgraph: document-corpus and temporal-graph analytics on Spark DataFrames."""
