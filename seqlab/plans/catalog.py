"""All registered queries."""

from seqlab.plans import (  # noqa: F401
    hmm_queries,
    linear_queries,
    lm_queries,
    round_queries,
    select_queries,
    text_queries,
)
from seqlab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
