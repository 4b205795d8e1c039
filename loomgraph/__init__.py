"""A knowledge-graph analytics engine on Spark."""
