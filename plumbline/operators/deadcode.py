"""Dead symbols from four tools' reports, and the allow-list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.regex import allowed

GO_SCHEMA = "array<struct<Funcs:array<struct<Name:string,Position:struct<File:string,Line:int>,Generated:boolean>>>>"
_S = "array<struct<name:string,line:int>>"
KNIP_SCHEMA = f"issues array<struct<file:string,files:{_S},exports:{_S},types:{_S},enumMembers:{_S},namespaceMembers:{_S}>>"
PERIPHERY_SCHEMA = "array<struct<kind:string,name:string,hints:array<string>,location:string>>"
# The kinds of findings; which list of a report, or which word, means which.
KNIP_KINDS = {"files": "file", "exports": "export", "types": "type", "enumMembers": "member", "namespaceMembers": "member"}
VULTURE_LINE = r"\A(.+?):([0-9]+): (.+?)(?: \(([0-9]+)% confidence\))?\z"
VULTURE_KINDS = {"function": "function", "method": "function", "property": "function", "class": "type", "import": "import", "variable": "variable", "attribute": "variable"}
PERIPHERY_KINDS = {"function": "function", "class": "type", "struct": "type", "enum": "type", "protocol": "type", "typealias": "type", "extension": "type", "var": "variable", "module": "import", "enumelement": "member"}


def detect(text: Column) -> Column:
    """deadcode, knip, periphery or vulture, by the first characters; null if none fits."""
    t = F.btrim(text)
    return (
        F.when(t.startswith("[") & t.contains('"hints"'), "periphery").when(t.startswith("[") | (t == "null"), "deadcode").when(t.startswith("{") & t.contains('"issues"'), "knip").when(F.split(t, "\n")[0].rlike(VULTURE_LINE), "vulture")
    )


def parse_dead(reports: DataFrame, text: str = "report") -> DataFrame:
    """file, line, name, kind of all reports (a text per row); an empty or unknown report raises."""
    rows = reports.select(F.col(text).alias("_t"), F.coalesce(detect(F.col(text)), F.raise_error(F.lit("unknown dead-code report"))).alias("_f"))
    of = lambda f: rows.filter(F.col("_f") == f)
    go = of("deadcode").select(F.explode(F.from_json("_t", GO_SCHEMA)).alias("p")).select(F.explode("p.Funcs").alias("f")).filter(~F.coalesce("f.Generated", F.lit(False)))
    go = go.select(F.col("f.Position.File").alias("file"), F.col("f.Position.Line").alias("line"), F.col("f.Name").alias("name"), F.lit("function").alias("kind"))
    knip = of("knip").select(F.explode(F.from_json("_t", KNIP_SCHEMA)["issues"]).alias("i"))
    lists = [_listed(F.col(f"i.{k}"), kind) for k, kind in KNIP_KINDS.items()]
    knip = knip.select(F.col("i.file").alias("file"), F.explode(F.concat(*lists)).alias("s")).select("file", "s.line", "s.name", "s.kind")
    lines = of("vulture").select(F.explode(F.split(F.btrim("_t"), "\n")).alias("l")).filter(F.btrim("l") != "")
    part = lambda k: F.regexp_extract("l", VULTURE_LINE, k)
    word, name = F.regexp_extract("m", r"\Aunused (\w+) '", 1), F.regexp_extract("m", r"'(.*)'\z", 1)
    kind = _mapped(word, VULTURE_KINDS)
    plain = F.col("m").startswith("unreachable") | F.col("m").startswith("unsatisfiable")
    kind = F.when(plain, "code").otherwise(F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown line: "), F.col("l")))))
    vulture = lines.select("l", part(1).alias("file"), F.try_to_number(part(2), F.lit("9999999999")).cast("int").alias("line"), part(3).alias("m")).select("file", "line", F.when(plain, F.col("m")).otherwise(name).alias("name"), kind.alias("kind"))
    at = r"(?s)\A(.*):([0-9]+):[^:]*\z"
    p = of("periphery").select(F.explode(F.from_json("_t", PERIPHERY_SCHEMA)).alias("p")).filter(F.array_contains("p.hints", "unused"))
    p = p.select(F.regexp_extract("p.location", at, 1).alias("file"), F.regexp_extract("p.location", at, 2).cast("int").alias("line"), F.col("p.name").alias("name"), F.coalesce(_mapped(F.substring_index("p.kind", ".", 1), PERIPHERY_KINDS), F.lit("function")).alias("kind"))
    return go.unionByName(knip).unionByName(vulture).unionByName(p)


def _listed(items: Column, kind: str) -> Column:
    return F.transform(F.coalesce(items, F.array().cast(_S)), lambda s: F.struct(F.coalesce(s["line"], F.lit(0)).alias("line"), s["name"].alias("name"), F.lit(kind).alias("kind")))


def _mapped(c: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def not_allowed(findings: DataFrame, entries: list[str]) -> DataFrame:
    return findings.filter(~allowed(F.col("file"), F.col("name"), entries))
