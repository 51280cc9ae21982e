"""Dates for the test tables."""

from __future__ import annotations

import datetime as dt


def day(s: str) -> dt.date:
    return dt.date.fromisoformat(s)
