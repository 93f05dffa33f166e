"""Pattern dialects: linear-time regular expressions with ASCII classes, and three kinds of globs, as Java patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[0-9A-Za-z_]"


def to_java(pattern: str) -> str:
    """A pattern whose classes and word boundaries mean ASCII, and whose ``$`` means the end of the text, for rlike."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        pair = pattern[k : k + 2]
        k += 1
        if c == "\\":
            k += 1
            ascii_class = {"\\w": "0-9A-Za-z_", "\\s": r"\t\n\f\r ", "\\d": "0-9"}.get(pair)
            if pair == "\\b" and not inside:
                out.append(f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))")
            elif ascii_class:
                out.append(ascii_class if inside else f"[{ascii_class}]")
            else:
                out.append(pair)
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append("\\z" if c == "$" and not inside else c)
    return "".join(out)


def quoted(c: str) -> str:
    return "\\" + c if c in r"\.+*?()|[]{}^$" else c


def exclude_glob(glob: str) -> str:
    """Paths to leave out: ``*`` in a segment, ``**/`` at any depth, ``?``; a bare name at any depth; a directory takes
    what it contains. Empty globs give an empty pattern."""
    glob = glob.removeprefix("./").strip().removesuffix("/")
    if not glob:
        return ""
    out = "" if "/" in glob else "(?:.*/)?"
    for part in re.findall(r"\*\*/|\*\*|.", glob, re.S):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or quoted(part)
    return f"(?s)\\A{out}(?:/.*)?\\z"


def path_glob(glob: str) -> str:
    """Shell-like path match of a whole path: ``*`` and ``?`` within a segment, classes ``[a-z]`` and ``[^a-z]``."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if c == "[":
            end = glob.index("]", k + 2)
            out += "[" + glob[k + 1 : end].replace("[", "\\[").replace("&&", "&\\&") + "]"
            k = end
        elif c == "\\":
            k += 1
            out += quoted(glob[k])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or quoted(c)
        k += 1
    return out


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether any exclude glob matches the path (with slashes)."""
    patterns = [p for p in map(exclude_glob, globs) if p]
    normal = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for p in patterns:
        out = out | normal.rlike(p)
    return out


def glob_pattern(glob: Column) -> Column:
    """``exclude_glob`` of a column of globs; null for an empty one."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(glob, r"^\./", "")), "/$", "")
    safe = F.regexp_replace(plain, r"([\\.+()|\[\]{}^$])", r"\\$1")
    parts = F.regexp_replace(F.regexp_replace(safe, r"\*\*", "\u0002"), "\u0002/", "\u0001")
    out = F.replace(F.replace(parts, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    out = F.replace(F.replace(out, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*"))
    return F.when(plain != "", F.concat(F.lit("(?s)\\A"), F.when(plain.contains("/"), "").otherwise("(?:.*/)?"), out, F.lit("(?:/.*)?\\z")))


def literal_folder(glob: Column) -> Column:
    """The folders that a glob names before its first wildcard or last part, with a slash; empty for a bare name."""
    return F.regexp_extract(F.trim(F.regexp_replace(glob, r"^\./", "")), "^((?:[^*?/]+/)*)[^/]+", 1)


def folders_above(path: Column) -> Column:
    """All that ``literal_folder`` may be of a glob that matches the path."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit("")), ends)).otherwise(F.array(F.lit("")))


def allowed(file: Column, name: Column, entries: list[str]) -> Column:
    """Whether an allow-list of dead code covers a finding: ``dir/``, a path glob, a glob of the base name, or a symbol
    (also as the last part of a dotted name). Blank lines and ``#`` lines are skipped."""
    out = F.lit(False)
    for e in (x.strip() for x in entries):
        if not e or e.startswith("#"):
            continue
        wild = any(c in e for c in "*?[")
        if e.endswith("/") and not wild:
            out = out | file.startswith(e)
        elif wild or "/" in e:
            rest = e.removeprefix("**/")
            lead = "" if rest == e and "/" in e else "(?:.*/)?"
            out = out | file.rlike(f"(?s)\\A{lead}{path_glob(rest)}\\z")
        else:
            out = out | (name == e) | name.endswith(f".{e}")
    return out
