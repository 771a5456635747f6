"""Queries over the driver's tables and their SQL, collected from the modules of ``tessella.plans``."""

from tessella.plans import extensions, graph, groups, joining, provenance, reading, scalars, selecting, stepping, telemetry  # noqa: F401
from tessella.plans.query import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
