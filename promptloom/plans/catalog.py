"""Importing the query modules fills the registry."""
from promptloom.plans import (  # noqa: F401
    file_queries,
    match_queries,
    name_queries,
    order_queries,
    prompt_queries,
    stream_queries,
)
from promptloom.plans.registry import CHECKS, QUERIES  # noqa: F401
