"""Audited business analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame. The data and its audit
trail (what was excluded, how each join behaved, which figures reconcile) are
both DataFrames, so they run and scale in the same way.
"""
