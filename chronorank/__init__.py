"""Temporal document retrieval on Spark DataFrames.

Ranks, routes and summarizes a time-stamped document collection: collection
statistics, event routing, query likelihood, relevance feedback, sentence
scoring and judgment analysis.  Every operator takes and returns DataFrames.
"""

from chronorank.session import get_session

__all__ = ["get_session"]
