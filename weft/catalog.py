"""All registered graph queries and their SQL."""

from __future__ import annotations

from weft.plans import iterative, mdl_plans, model_plans, motif_plans, registry, report_plans, sampling_plans, structure, substructure_plans, temporal_plans  # noqa: F401


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict:
    return registry.SQL


def flagship(spark, sf_dir):
    return model_plans.flagship(spark, sf_dir)
