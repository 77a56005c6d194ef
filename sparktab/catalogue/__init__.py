"""Named queries over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import anomalies, evaluation, modelling, plans_, profiling

QUERIES = profiling.QUERIES | modelling.QUERIES | evaluation.QUERIES | plans_.QUERIES | anomalies.QUERIES
ORACLES = profiling.ORACLES | modelling.ORACLES | evaluation.ORACLES | plans_.ORACLES | anomalies.ORACLES
