"""All registered queries of the core library and their DuckDB SQL."""

from __future__ import annotations

from qualitylens.plans import aggregates, graphs, joins, projections, resolution, sequences, state  # noqa: F401
from qualitylens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """Daily coherence state of the channels."""
    return QUERIES["q170_coherence_state"](spark, sf_dir)
