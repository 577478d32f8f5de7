"""Follower-graph analytics on Spark: rosters, edges, factors, similar accounts."""
