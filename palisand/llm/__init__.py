"""Operators for preparing training data at corpus scale.

Nothing outside this folder imports it.  Every operator takes a DataFrame,
reads only the columns it names (any other column is ignored, so a clashing
name does no harm), accepts null in each of them, and keeps repeated rows:
a row is a document.
"""
