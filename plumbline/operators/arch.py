"""Import edges between packages: layer rules with exceptions, coupling, the stable-dependencies principle, diffs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.regex import excluded, folders_above, glob_pattern, literal_folder
from plumbline.functions.text import package_of


@dataclass(frozen=True)
class Rule:
    name: str
    source: str
    deny: tuple[str, ...]


@dataclass(frozen=True)
class Allowed:
    """An exception from a rule."""

    rule: str
    source: str
    target: str


def checked(rules: list[Rule], exceptions: list[Allowed] = ()) -> None:
    for r in rules:
        if not (r.name and r.source and r.deny):
            raise ValueError(f"rule {r.name!r} needs a name, a source and what it denies")
    for e in exceptions:
        if not (e.rule and e.source and e.target):
            raise ValueError(f"exception from {e.rule!r} needs a rule, a source and a target")


def arch_edges(edges: DataFrame) -> DataFrame:
    """From file edges (src, ord, dst): file, from_pkg, import, to_pkg, ord."""
    return edges.select(F.col("src").alias("file"), package_of(F.col("src")).alias("from_pkg"), F.col("dst").alias("import"), package_of(F.col("dst")).alias("to_pkg"), "ord")


def violations(edges: DataFrame, rules: list[Rule], exceptions: list[Allowed] = ()) -> DataFrame:
    """rule, from_pkg, to_pkg, file, import. Rules are few and stand in the plan as predicates: one pass, no join."""
    checked(rules, exceptions)

    def breaks(r: Rule) -> Column:
        bad = excluded(F.col("from_pkg"), [r.source]) & excluded(F.col("to_pkg"), list(r.deny))
        for e in exceptions:
            if e.rule == r.name:
                bad = bad & ~(excluded(F.col("from_pkg"), [e.source]) & excluded(F.col("to_pkg"), [e.target]))
        return F.when(bad, F.lit(r.name))

    across = edges.filter("from_pkg <> to_pkg")
    if not rules:
        return across.limit(0).select(F.lit("").alias("rule"), "from_pkg", "to_pkg", "file", "import")
    return across.select(F.explode(F.array_compact(F.array(*map(breaks, rules)))).alias("rule"), "from_pkg", "to_pkg", "file", "import")


#: Parts that the edges below a folder at the top are dealt over.
PARTS = 16


def rule_violations(edges: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``violations`` with rules(rule, source, deny array) and exceptions(rule, source, target) as tables, of any length.

    A rule is found by the literal folders that its source begins with: the folders above an edge's package are joined with
    them, and only then are globs matched, so a rule meets the edges below its folder and the plan doesn't grow with rules.
    Rules whose source begins with a wildcard or is a bare name meet all edges. Rules of one name are one rule each. Only folders
    as deep as some rule's are joined, and edges below a shallow one, which may be most of all, are dealt over ``PARTS`` parts.
    """
    of = rules.select("rule", literal_folder(F.col("source")).alias("folder"), glob_pattern(F.col("source")).alias("from_glob"), F.array_join(F.array_compact(F.transform("deny", glob_pattern)), "|").alias("to_glob")).filter("from_glob is not null and to_glob <> ''")
    path = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    depth = F.length("folder") - F.length(F.replace("folder", F.lit("/")))
    shallow = depth <= 1
    depths = of.select(depth.alias("depth")).distinct()  # as many as a path has folders
    above = edges.filter("from_pkg <> to_pkg").select("from_pkg", "to_pkg", "file", "import", F.explode(folders_above(F.col("from_pkg"))).alias("folder")).withColumn("depth", depth)
    across = above.join(F.broadcast(depths), "depth").withColumn("part", F.when(shallow, F.pmod(F.xxhash64("from_pkg", "to_pkg", "file", "import"), F.lit(PARTS)).cast("int")).otherwise(0))
    of = of.withColumn("part", F.explode(F.when(shallow, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))))
    met = across.join(of, ["folder", "part"]).filter(F.rlike(path("from_pkg"), F.col("from_glob")) & F.rlike(path("to_pkg"), F.col("to_glob")))
    out = met.select("rule", "from_pkg", "to_pkg", "file", "import")
    if exceptions is None:
        return out
    free = exceptions.select(F.col("rule").alias("of"), glob_pattern(F.col("source")).alias("from_glob"), glob_pattern(F.col("target")).alias("to_glob"))
    return out.join(free, (F.col("rule") == F.col("of")) & F.rlike(path("from_pkg"), F.col("from_glob")) & F.rlike(path("to_pkg"), F.col("to_glob")), "left_anti")


def package_pairs(edges: DataFrame) -> DataFrame:
    """from_pkg, to_pkg, file, import: each pair once, with the first edge of its smallest file."""
    at = F.struct("file", "ord")
    return edges.filter("from_pkg <> to_pkg").groupBy("from_pkg", "to_pkg").agg(F.min("file").alias("file"), F.min_by("import", at).alias("import"))


def coupling(pairs: DataFrame) -> DataFrame:
    """package, afferent, efferent, instability = efferent / (afferent + efferent)."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("from_pkg").alias("package"), F.lit(0).alias("a"), F.lit(1).alias("e")), F.struct(F.col("to_pkg").alias("package"), F.lit(1).alias("a"), F.lit(0).alias("e")))).alias("s"))
    by = sides.groupBy(F.col("s.package").alias("package")).agg(F.sum("s.a").alias("afferent"), F.sum("s.e").alias("efferent"))
    return by.withColumn("instability", F.col("efferent") / (F.col("afferent") + F.col("efferent")))


def stability_violations(pairs: DataFrame) -> DataFrame:
    """Pairs whose source is more stable than what it depends on."""
    i = coupling(pairs)
    of = lambda side: i.select(F.col("package").alias(f"{side}_pkg"), F.col("instability").alias(f"{side}_instability"))
    return pairs.join(of("from"), "from_pkg").join(of("to"), "to_pkg").filter("from_instability < to_instability").select("from_pkg", "from_instability", "to_pkg", "to_instability", "file", "import")


def new_since(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Stability violations that the baseline doesn't hold."""
    return found.join(baseline.select("from_pkg", "to_pkg"), ["from_pkg", "to_pkg"], "left_anti")


def arch_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["rule", "file", "import"]
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").withColumn("change", F.lit("new"))
    fixed = old.dropDuplicates(keys).join(new.select(*keys), keys, "left_anti").withColumn("change", F.lit("fixed"))
    return fresh.unionByName(fixed)
