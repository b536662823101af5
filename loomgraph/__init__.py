"""loomgraph: property-graph queries on Spark DataFrames."""
