"""All registered queries of the base package."""

from kbspark.plans import access_queries, evaluation_queries, fold_queries, governance_queries, intake_queries, parent_queries, question_queries, replay_queries, trace_queries  # noqa: F401  (they register themselves)
from kbspark.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
