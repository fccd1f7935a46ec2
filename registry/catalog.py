"""All registered queries."""

from __future__ import annotations

from registry import q_baseline, q_explain, q_features, q_monitor, q_reports, q_sources, q_streams  # noqa: F401
from registry.core import CHECKS, QUERIES
