"""Card-round analytics on Spark: per-seat hand features, per-person totals, one-row summary."""

from tricklens.model import COMPASS_ROSTER, METRICS, ROUNDS_SCHEMA, Roster, Rules, summary_columns
from tricklens.plans.summary import summarize, summarize_table, totals_by_person, totals_by_person_table

__all__ = [
    "COMPASS_ROSTER",
    "METRICS",
    "ROUNDS_SCHEMA",
    "Roster",
    "Rules",
    "summarize",
    "summarize_table",
    "summary_columns",
    "totals_by_person",
    "totals_by_person_table",
]
