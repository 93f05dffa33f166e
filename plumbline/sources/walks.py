"""Which files of a tree each consumer reads, as predicates over paths: usable on any table of paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.paths import base_name, folder_parts


@dataclass(frozen=True)
class Walk:
    """Names of folders that are left out (besides those that begin with a dot), patterns of the file names that are taken
    and of those that aren't. ``dot_files``: whether files that begin with a dot are taken."""

    skip: frozenset[str]
    take: str
    leave: str = ""
    dot_files: bool = True


def _walk(skip: str, take: str, leave: str = "", dot_files: bool = True) -> Walk:
    return Walk(frozenset(skip.split()), take, leave, dot_files)


# Folders and names by consumer.
SCRIPTS = r"\.(?:ts|tsx|js|jsx)\z"
SCRIPT_TESTS = r"\.(?:test|spec)\.(?:ts|tsx|js|jsx)\z"
PYTHON_TESTS = r"\Atest_|_test\.py\z"
SWIFT_TESTS = r"Tests?\.swift\z"
WALKS = {
    "go": _walk("vendor testdata", r"\.go\z", r"_test\.go\z"),
    "go-tok": _walk("vendor testdata", r"\.go\z", r"_test\.go\z"),
    "swift": _walk("Pods Tests", r"\.swift\z", SWIFT_TESTS),
    "swift-tok": _walk("Pods Tests", r"\.swift\z", SWIFT_TESTS),
    "ts": _walk("node_modules", SCRIPTS, r"\.d\.ts\z|" + SCRIPT_TESTS, False),
    "ts-tok": _walk("node_modules", SCRIPTS, r"\.d\.ts\z|" + SCRIPT_TESTS, False),
    "py-size": _walk("node_modules __pycache__ venv site-packages vendor", r"\.py\z"),
    "py-tok": _walk("__pycache__", r"\.py\z", PYTHON_TESTS),
    "escape-go": _walk("vendor node_modules testdata", r"\.go\z", r"_test\.go\z"),
    "escape-python": _walk("vendor node_modules testdata", r"\.py\z", r"_test\.py\z"),
    "escape-ts": _walk("vendor node_modules testdata", SCRIPTS, SCRIPT_TESTS),
    "escape-swift": _walk("vendor node_modules testdata", r"\.swift\z", SWIFT_TESTS),
    "import-py": _walk("__pycache__ venv testdata", r"\.py\z"),
    "import-ts": _walk("node_modules testdata", SCRIPTS, r"\.d\.ts\z"),
    "import-go": _walk("vendor testdata", r"\.go\z"),
    "tests-go": _walk("vendor node_modules testdata", r"_test\.go\z"),
    "tests-py": _walk("node_modules __pycache__ venv site-packages vendor", r"\Atest_.*\.py\z|_test\.py\z"),
    "tests-ts": _walk("node_modules", SCRIPT_TESTS, "", False),
    "tests-swift": _walk("Pods Carthage DerivedData vendor node_modules testdata checkouts", r"\.swift\z"),
}
_COMMON = "node_modules vendor testdata Pods venv __pycache__"
_ANY_CASE_SCRIPTS = r"(?i)\.(?:ts|tsx|js|jsx)\z"
ALIASES = {"golang": "go", "py": "python", "typescript": "ts", "js": "ts", "javascript": "ts"}
#: By language: source files and test files that a gate must have analysed.
ELIGIBLE = {
    "go": (_walk(_COMMON, r"\.go\z", r"_test\.go\z"), _walk(_COMMON, r"_test\.go\z")),
    "python": (_walk(_COMMON, r"\.py\z", PYTHON_TESTS), _walk(_COMMON, r"\Atest_.*\.py\z|_test\.py\z")),
    "ts": (_walk(_COMMON, _ANY_CASE_SCRIPTS, r"\.d\.ts\z|\.(?:test|spec)\."), _walk(_COMMON, r"\.(?:test|spec)\.(?i:(?:.*\.)?(?:ts|tsx|js|jsx))\z", r"\.d\.ts\z")),
    "swift": (_walk(_COMMON + " Tests", r"\.swift\z", SWIFT_TESTS), _walk(_COMMON, SWIFT_TESTS)),
}


def walked(path: Column, walk: Walk) -> Column:
    """Whether a walk from the top takes the file at a path (with slashes)."""
    skip = F.array(*(F.lit(s) for s in sorted(walk.skip)))
    out = ~F.arrays_overlap(folder_parts(path), skip) & ~F.exists(folder_parts(path), lambda s: s.startswith("."))
    name = base_name(path)
    out = out & name.rlike(walk.take)
    if walk.leave:
        out = out & ~name.rlike(walk.leave)
    return out if walk.dot_files else out & ~name.startswith(".")


def eligible(path: Column, lang: str, tests: bool | None = False) -> Column:
    """Whether a gate of the language must have analysed the file: source files, test files or (None) both."""
    key = ALIASES.get(lang, lang)
    if key not in ELIGIBLE:
        return F.lit(False)
    source, test = ELIGIBLE[key]
    if tests is None:
        return walked(path, source) | walked(path, test)
    return walked(path, test if tests else source)
