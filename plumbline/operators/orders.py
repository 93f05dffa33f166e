"""The stated orders of reports, each made total by further keys, so that equal rows come in the same order in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _columns(names: str) -> list[Column]:
    """Names, with a minus sign before those that go down; nulls come last."""
    return [F.col(n[1:]).desc_nulls_last() if n[0] == "-" else F.col(n).asc_nulls_last() for n in names.split()]


ORDERS = {
    "crap": "-crap file start_line name",
    "size": "file start_line kind name",
    "clones": "-tokens file_a start_line_a file_b start_line_b",
    "hatches": "file line pattern",
    "violations": "rule file import",
    "findings": "file line test check_ord",
    "crapdiff": "-delta file name",
    "survivors": "file line status",
}


def in_order(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in the order of a report of this kind; keys that the rows don't have are left out."""
    if kind == "cycles":  # the largest first, then by their first file
        return rows.orderBy(F.size("files").desc(), F.element_at("files", 1))
    if kind == "archdiff":  # what is new before what is fixed
        return rows.orderBy(F.when(F.col("change") == "new", 0).otherwise(1), *_columns("rule file import"))
    names = [n for n in ORDERS[kind].split() if n.lstrip("-") in rows.columns]
    return rows.orderBy(*_columns(" ".join(names)))
