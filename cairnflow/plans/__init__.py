"""Queries over the driver's tables, each the use of an operator by analogy to its own domain.

Importing the modules registers their queries in ``cairnflow.catalogue``.
"""

from . import credits, decisions, identity, intervals, lookups, nearness, ordered, relational, stores, textual, transcripts  # noqa: F401
