"""Sequence-network analytics on Spark DataFrames.

Events become ordered sequences per case, sequences become weighted directed
networks, and networks are condensed into trees, poly-trees and paths.  Every
operator takes DataFrames and returns DataFrames; a ``graph_id`` column lets one
job build and condense many networks at once.
"""
