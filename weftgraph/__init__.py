"""weftgraph: property-graph analytics of code symbols as Spark DataFrames."""
