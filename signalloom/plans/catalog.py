"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from signalloom.plans import arbitration_queries, epoch_queries, evaluation_queries, experiment_queries, fusion_queries, model_queries, record_queries, recording_queries, system_queries  # noqa: F401
from signalloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
