"""Queries over the tables of a data folder: ``QUERIES`` by name and the ``SQL`` that they match."""

from lexispark.plans import evaluation_queries, retrieval_queries, source_queries, vocabulary_queries  # noqa: F401  they register their queries
from lexispark.plans.catalog import QUERIES, SQL  # noqa: F401
