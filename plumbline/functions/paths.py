"""Paths with slashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def cleaned(path: Column) -> Column:
    """Without empty and ``.`` segments, ``..`` taken back where something stands before it; ``.`` if nothing is left."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def step(acc: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(acc) > 0) & (last(acc) != "..")
        return F.when(s.isin("", "."), acc).when(back, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))

    parts = F.aggregate(F.split(slashed(path), "/"), F.array().cast("array<string>"), step)
    lead = F.when(slashed(path).startswith("/"), "/").otherwise("")
    out = F.concat(lead, F.array_join(parts, "/"))
    return F.when(out == "", ".").otherwise(out)


def relative_to(path: Column, folder: str) -> Column:
    """A cleaned path, without the folder where it stands in it; other paths stay as they are, cleaned."""
    lead = folder.replace("\\", "/").rstrip("/") + "/"
    clean = cleaned(path)
    return F.when(clean.startswith(lead), F.substring(clean, F.lit(len(lead) + 1), F.length(clean))).otherwise(clean)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_parts(path: Column) -> Column:
    """The folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)
