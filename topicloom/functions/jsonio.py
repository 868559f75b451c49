"""Nested records as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how dates are written.
DATE_FORMAT = "yyyy/MM/dd"


def write(record: str | Column) -> Column:
    return F.to_json(record, {"dateFormat": DATE_FORMAT})


def read(text: str | Column, schema: str) -> Column:
    """Fields by name; text that does not fit the schema fails the query."""
    return F.from_json(text, schema, {"mode": "FAILFAST", "dateFormat": DATE_FORMAT})
