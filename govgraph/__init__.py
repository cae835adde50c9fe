"""govgraph: governed knowledge-graph analytics on DataFrames."""
