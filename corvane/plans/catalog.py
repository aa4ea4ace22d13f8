"""The query catalogue: name -> callable, and name -> SQL."""

from corvane.plans import assembly, corpus, coverage, evaluation, merging, pipelines, ranking, relational, states, supervision  # noqa: F401  (they register their queries)
from corvane.plans.registry import QUERIES, SQL

FLAGSHIP = QUERIES["bm25_topk"]
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
