"""All queries of the library over the driver's tables."""

from __future__ import annotations

from ferrule.jobs import evaluation_jobs, flow_jobs, interval_jobs, knowledge_jobs, metric_jobs, model_jobs, relational_jobs, search_jobs, text_jobs, traversal_jobs
from ferrule.jobs.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "evaluation_jobs", "flow_jobs", "interval_jobs", "knowledge_jobs", "metric_jobs", "model_jobs", "relational_jobs", "search_jobs", "text_jobs", "traversal_jobs"]
