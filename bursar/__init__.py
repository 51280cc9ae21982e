"""Spark-native school-finance analytics.

Tables (students, classes, terms, payments, discounts, boarding fee, fee defaults, uniform items and
issues, staff roster) are plain DataFrames. Every report is a DataFrame expression over the whole
population; every change is a batch job ``apply_x(base, commands) -> (new_base, rejects)``.
"""

from bursar.session import get_session

__all__ = ["get_session"]
