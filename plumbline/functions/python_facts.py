"""Facts about Python files from the standard parser and tokenizer: one row in, rows out, as an Arrow-batched map.

Files that don't parse have no functions and no tokens.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
# Token kinds that carry no code.
BLANK_TOKENS = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}


def complexity(body: list[ast.stmt]) -> int:
    """McCabe: 1, and 1 for each branch, further boolean operand, comprehension and condition in it, ``else`` of a loop or a
    try, and match case (without a last one that takes everything). Functions and classes inside count for themselves."""
    total, work = 1, list(body)
    while work:
        x = work.pop()
        if isinstance(x, (*DEFS, ast.ClassDef)):
            continue
        total += isinstance(x, BRANCHES)
        if isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            total += len(x.ifs)
        elif isinstance(x, ast.Match):
            total += len(x.cases) - any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in x.cases)
        elif isinstance(x, (ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar)):
            total += bool(x.orelse)
        work += ast.iter_child_nodes(x)
    return total


def nesting(body: list[ast.stmt]) -> int:
    """Depth of control blocks; an elif is as deep as its if; functions and classes inside don't count."""
    deepest = 0
    for x in body:
        if not isinstance(x, NESTING):
            continue
        inner = 0
        for name in ("body", "orelse", "finalbody", "handlers", "cases"):
            part = getattr(x, name, [])
            if name == "orelse" and isinstance(x, ast.If) and len(part) == 1 and isinstance(part[0], ast.If):
                deepest = max(deepest, nesting(part))
                continue
            for y in part:
                inner = max(inner, nesting(y.body) if isinstance(y, (ast.ExceptHandler, ast.match_case)) else nesting([y]))
        deepest = max(deepest, 1 + inner)
    return deepest


def parameters(node: ast.FunctionDef, method: bool) -> int:
    """Declared parameters; of a method the first one is the instance's or the class's, whatever its name, unless it's static."""
    marks = {ast.unparse(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2] for d in node.decorator_list}
    declared = sum(1 for x in ast.walk(node.args) if isinstance(x, ast.arg) and x not in _inner(node.args))
    return max(declared - 1, 0) if method and "staticmethod" not in marks else declared


def _inner(arguments: ast.arguments) -> set[ast.arg]:
    """Parameters of lambdas in defaults and annotations."""
    return {y for x in ast.walk(arguments) if isinstance(x, ast.Lambda) for y in ast.walk(x.args) if isinstance(y, ast.arg)}


def functions_of(content: str) -> list[tuple]:
    """(name, start_line, end_line, complexity, param_count, max_nesting_depth) of functions and of methods of classes;
    what is defined inside of a function or of a class in a class has no row."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []

    def visit(nodes: list[ast.AST], prefix: str, method: bool) -> None:
        for x in nodes:
            if isinstance(x, DEFS):
                out.append((prefix + x.name, x.lineno, x.end_lineno, complexity(x.body), parameters(x, method), nesting(x.body)))
            elif isinstance(x, ast.ClassDef):
                if not method:
                    visit(x.body, f"{x.name}.", True)
            else:
                visit(list(ast.iter_child_nodes(x)), prefix, method)

    visit(tree.body, "", False)
    return out


# Names that tell what a test does.
HELPERS = "(?i)^_?(assert|check|verify|expect|ensure|validate|compare)"
MOCK_ASSERTS = [
    "assert_called", "assert_called_once", "assert_called_with", "assert_called_once_with", "assert_any_call", "assert_has_calls", "assert_not_called", "assert_awaited", "assert_awaited_once", "assert_awaited_with", "assert_awaited_once_with", "assert_any_await",
    "assert_has_awaits", "assert_not_awaited",
]
MOCK_ATTRIBUTES = ["called", "call_count", "call_args", "call_args_list", "mock_calls", "method_calls"]
PYTEST_CHECKS = ["raises", "warns", "deprecated_call", "fail"]
TEMP_CLEANED = ["rmtree", "unlink", "remove", "rmdir", "removedirs", "addCleanup", "addfinalizer", "cleanup"]
TEMP_MADE = ["mkdtemp", "mkstemp"]
SKIPS = ["pytest.skip", "self.skipTest"]
EXPECTED_FAILURE = ["xfail", "expectedFailure"]
GUARDS = (ast.If, ast.Try, ast.Match)


def test_events(content: str) -> Iterator[tuple[int, str, str, list[str], bool]]:
    """(line, test, event, texts, guarded): what a file's tests are made of, nothing judged. A test is a function named test...,
    at the top or in a class that is named Test... or has a base. Events: ``test`` once a test; ``mark`` with each decorator of it
    or of its class; ``call`` with what is called, as source; ``assert`` with the attributes in its condition; ``finally``.
    guarded: below an if, a try or a match. Files that don't parse have none."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return
    classes = [(f"{c.name}.", c.decorator_list, c.body) for c in tree.body if isinstance(c, ast.ClassDef) and (c.name.startswith("Test") or c.bases)]
    for prefix, shared, body in [("", [], tree.body), *classes]:
        for test in (x for x in body if isinstance(x, DEFS) and x.name.startswith("test")):
            of = test.lineno, prefix + test.name
            yield *of, "test", [], False
            for d in [*shared, *test.decorator_list]:
                yield *of, "mark", [_callee(d)], False
            nodes = [x for statement in test.body for x in ast.walk(statement)]
            guarded = {id(x) for g in nodes if isinstance(g, GUARDS) for child in ast.iter_child_nodes(g) for x in ast.walk(child)}
            for x in nodes:
                if isinstance(x, ast.Call):
                    yield *of, "call", [_callee(x)], id(x) in guarded
                elif isinstance(x, ast.Assert):
                    yield *of, "assert", sorted({y.attr for y in ast.walk(x.test) if isinstance(y, ast.Attribute)}), id(x) in guarded
                elif isinstance(x, ast.Try) and x.finalbody:
                    yield *of, "finally", [], id(x) in guarded


def _callee(node: ast.expr) -> str:
    while isinstance(node, ast.Call):
        node = node.func
    return ast.unparse(node)


def tokens_of(content: str) -> list[tuple[str, int]]:
    try:
        return [(t.string, t.start[0]) for t in tokenize.generate_tokens(io.StringIO(content).readline) if t.type not in BLANK_TOKENS]
    except (tokenize.TokenError, SyntaxError):
        return []


def _flat(files: DataFrame, of, schema: str, columns: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f, *r) for f, c in zip(frame["file"], frame["content"], strict=True) for r in of(c or "")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "content").mapInPandas(run, schema)


def python_functions(files: DataFrame) -> DataFrame:
    columns = ["file", "name", "start_line", "end_line", "complexity", "param_count", "max_nesting_depth"]
    return _flat(files, functions_of, "file string, name string, " + ", ".join(f"{c} int" for c in columns[2:]), columns)


def python_tokens(files: DataFrame) -> DataFrame:
    """file, text, line, pos"""
    return _flat(files, lambda c: [(t, n, k) for k, (t, n) in enumerate(tokens_of(c))], "file string, text string, line int, pos int", ["file", "text", "line", "pos"])


def python_test_events(files: DataFrame) -> DataFrame:
    """file and the events of its tests (``test_events``)."""
    return _flat(files, test_events, "file string, line int, name string, event string, texts array<string>, guarded boolean", ["file", "line", "name", "event", "texts", "guarded"])


def judged_tests(events: DataFrame) -> DataFrame:
    """The facts of each test, as ``testmetric`` takes them, from the events of tests in any language."""
    text, event = F.coalesce(F.try_element_at("texts", F.lit(1)), F.lit("")), F.col("event")
    full = F.regexp_extract(text, r"(?U)(\w+(?:\.\w+)*)$", 1)  # the dotted name at the end
    last = F.substring_index(full, ".", -1)
    call, mark = event == "call", event == "mark"
    on_mock = call & last.isin(MOCK_ASSERTS)
    checks = call & (last.rlike(HELPERS) | (last.isin(PYTEST_CHECKS) & full.startswith("pytest.")))
    plain = call & ~on_mock & ~checks
    reads_mock = (event == "assert") & F.arrays_overlap("texts", F.array(*map(F.lit, MOCK_ATTRIBUTES)))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return events.groupBy("file", "line", "name").agg(
        F.lit(False).alias("suite"), F.count_if((event == "assert") | on_mock | checks).cast("int").alias("assertions"), F.count_if(reads_mock | on_mock).cast("int").alias("interactions"),
        (some(mark & (last == "skip")) | some(plain & full.isin(SKIPS) & ~F.col("guarded"))).alias("skipped"), F.lit(False).alias("focused"), some(mark & last.isin(EXPECTED_FAILURE)).alias("expected_failure"),
        (some(plain & last.isin(TEMP_MADE)) & ~some((plain & last.isin(TEMP_CLEANED)) | (event == "finally"))).alias("uncleaned_temp"),
    )


def python_tests(files: DataFrame) -> DataFrame:
    """file and the facts of each test."""
    return judged_tests(python_test_events(files))
