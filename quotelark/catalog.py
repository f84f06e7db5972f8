"""All queries over the driver tables by name, and the SQL for each."""

from __future__ import annotations

from quotelark.plans import bets, board, casework, fits, history, models, more, names, quotes, rates, research, scans, streams, studies, temporal  # noqa: F401
from quotelark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "flagship_daily_scan"
