"""Design-graph analytics on Spark: snapshots of port-level property graphs as DataFrames."""
