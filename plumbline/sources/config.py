"""Small files that steer a run, read by the driver: lists, layer rules, path mappings; and reports read and written."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.arch import Allowed, Rule, checked


def inside(root: str, path: str) -> bool:
    """Whether a path of a local file system lies below root when links are followed; remote paths have none to follow."""
    if "://" in root and not root.startswith("file://"):
        return True
    top = os.path.realpath(root.removeprefix("file://"))
    real = os.path.realpath(os.path.join(top, path))
    return real == top or real.startswith(top.rstrip("/") + "/")


def read_inside(root: str, path: str) -> str:
    """The text of a file below root; links and ``..`` that lead out are refused."""
    if not inside(root, path):
        raise PermissionError(f"{path} leads out of {root}")
    return (Path(root.removeprefix("file://")) / path).read_text("utf-8", "replace")


def write_inside(root: str, path: str, text: str) -> None:
    if not inside(root, path):
        raise PermissionError(f"{path} leads out of {root}")
    (Path(root.removeprefix("file://")) / path).write_text(text, "utf-8")


# lists


def exclude_list(text: str) -> list[str]:
    """Globs, one a line; ``#`` begins a comment anywhere."""
    return [x for x in (line.partition("#")[0].strip() for line in text.split("\n")) if x]


def ignore_list(text: str) -> list[str]:
    """Entries of an allow-list, one a line; lines that begin with ``#`` are comments. Unclosed classes are errors."""
    out = [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]
    for n, x in enumerate(out, 1):
        if re.search(r"(?<!\\)\[(?:[^\]]*\Z|\])", x):
            raise ValueError(f"entry {n}: bad glob {x!r}")
    return out


def layer_rules(text: str) -> tuple[list[Rule], list[Allowed]]:
    """``{"rules": [{name, from, deny}], "exceptions": [{rule, from, to}]}``; without rules an error."""
    read = json.loads(text)
    rules = [Rule(r.get("name", ""), r.get("from", ""), tuple(r.get("deny", ()))) for r in read.get("rules") or ()]
    exceptions = [Allowed(e.get("rule", ""), e.get("from", ""), e.get("to", "")) for e in read.get("exceptions") or ()]
    if not rules:
        raise ValueError("no rules declared")
    checked(rules, exceptions)
    return rules, exceptions


# path mappings and modules

_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|/\*|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])', re.S)


def plain_json(text: str) -> str:
    """JSON without comments and trailing commas; a block comment without an end is an error."""

    def piece(m: re.Match) -> str:
        if m[0] == "/*":
            raise ValueError("a block comment has no end")
        return m[0] if m[0][0] == '"' else " "

    return _PIECES.sub(piece, text)


@dataclass(frozen=True)
class PathMapping:
    """A specifier pattern with at most one ``*``, and where it leads, in order."""

    pattern: str
    targets: tuple[str, ...]

    @property
    def rank(self) -> tuple:
        """Exact patterns first, then the longest text before the star, then the longest after it."""
        before, star, after = self.pattern.partition("*")
        return (bool(star), -len(before), -len(after))


def path_mappings(text: str) -> tuple[str, list[PathMapping]]:
    """The base folder and the mappings of a compiler configuration, the most specific first."""
    options = json.loads(plain_json(text)).get("compilerOptions") or {}
    out = []
    for pattern, targets in (options.get("paths") or {}).items():
        if not targets or not all(targets):
            raise ValueError(f"{pattern!r} has no target or an empty one")
        if pattern.count("*") > 1:
            raise ValueError(f"{pattern!r} has more than one wildcard")
        out.append(PathMapping(pattern, tuple(targets)))
    return os.path.normpath(options.get("baseUrl") or "."), sorted(out, key=lambda m: m.rank)


def find_module(folder: str) -> tuple[str, str]:
    """(folder, module path) of the nearest ``go.mod`` at or above a folder."""
    here = Path(folder).resolve()
    for d in (here, *here.parents):
        if (d / "go.mod").is_file():
            found = re.search(r"(?m)^\s*module[ \t]+(.*?)\s*$", (d / "go.mod").read_text())
            if not found:
                raise ValueError(f"{d}/go.mod declares no module")
            return str(d), found[1]
    raise ValueError(f"no go.mod at or above {here}")


def repository_root(folder: str) -> str:
    """The nearest folder upwards with ``.git``, else the outermost one with ``go.mod``, else the folder."""
    here = Path(folder).resolve()
    line = [here, *here.parents]
    with_git = [d for d in line if (d / ".git").exists()]
    with_module = [d for d in line if (d / "go.mod").is_file()]
    return str(with_git[0] if with_git else with_module[-1] if with_module else here)


# reports


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report written as indented JSON; the schema is given, since lists without entries are null there."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def report_json(report: DataFrame) -> DataFrame:
    """One column ``value``: each row of a report as indented JSON; empty lists are written as they are."""
    return report.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def exit_code(report: DataFrame) -> int:
    """0 if every row's ``passed`` holds, 1 otherwise."""
    return 0 if report.filter(~F.col("passed")).isEmpty() else 1


def exit_status(report: Callable[[], DataFrame]) -> int:
    """``exit_code`` of the report that a call makes; 2 if it can't be made: wrong names or values, files that can't be read."""
    try:
        return exit_code(report())
    except (ValueError, OSError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 2
