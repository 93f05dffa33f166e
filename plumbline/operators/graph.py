"""Graphs as edge tables: connected components, strongly connected components, cycle chains."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import discard, written

if TYPE_CHECKING:
    import pandas as pd
    import pyarrow as pa


#: Edges up to which one task finds the components; a choice of the plan, the result is the same.
ONE_TASK = 500_000


def connected_components(edges: DataFrame, name: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """edges(a long, b long) -> (node, component): the smallest node that each node of an edge reaches.

    A table of at most ``one_task`` distinct edges, counted first, is solved by one task in one pass. Larger ones by
    alternating large and small stars: a round costs two shuffles of the edges and is written to the shared folder, so
    that no lineage grows and a lost executor costs one round. Grouped minima are combined before the shuffle; no
    neighbourhood is gathered in a task. Rounds are logarithmic in the length of the longest chain. Nulls and loops are
    ignored.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if now.count() <= one_task:
        out = written(now.coalesce(1).mapInArrow(_rooted, "node long, component long"), name)
        discard(now)
        return out
    while not _flat(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours point to the smallest one
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # small star: a node and its smaller neighbours point to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        before, now = now, written(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
        discard(before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> node and the smallest node that it reaches."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        up = parent.setdefault(x, x)
        while up != (top := parent[up]):
            parent[x] = top
            x, up = up, top
        return up

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], names=["node", "component"])


def _flat(edges: DataFrame) -> bool:
    """Whether each node points to one other that points nowhere: all components are stars."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("s"))
    by = sides.groupBy("s.node").agg(F.sum("s.out").alias("out"), F.max("s.into").alias("into"))
    return by.filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(src, dst) -> edges(a long, b long) and nodes(name, node), numbered in the order of the names, of numbers by value."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).filter("name is not null").distinct().orderBy(F.expr("try_cast(name as bigint)"), "name")
    nodes = written(names.withColumn("node", F.monotonically_increasing_id()), "graph-nodes")
    by = lambda c, n: nodes.select(F.col("name").alias(c), F.col("node").alias(n))
    return written(edges.join(by("src", "a"), "src").join(by("dst", "b"), "dst").select("a", "b").distinct(), "graph-edges"), nodes


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Without edges from nodes that nothing enters or to nodes that nothing leaves: these are in no cycle. A few rounds
    leave little of a graph that is mostly layered; the rest goes on as it is. A round that removes nothing is the last."""
    edges = written(edges, "graph-core")
    size = edges.count()
    for _ in range(rounds):
        sources, targets = edges.select("a").distinct(), edges.select("b").distinct()
        less = written(edges.join(targets.select(F.col("b").alias("a")), "a", "left_semi").join(sources.select(F.col("a").alias("b")), "b", "left_semi"), "graph-core")
        discard(edges)
        edges, before = less, size
        size = edges.count()
        if size == before:
            break
    return edges


def tarjan(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Node -> smallest node of its strongly connected component, without recursion."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    place: dict[int, int] = {}  # of the nodes that are held
    component: dict[int, int] = {}
    for root in sorted(out):
        if root in order:
            continue
        work = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        place[root] = len(held)
        held.append(root)
        while work:
            node, targets = work[-1]
            for t in targets:
                if t not in order:
                    order[t] = low[t] = len(order)
                    place[t] = len(held)
                    held.append(t)
                    work.append((t, iter(out[t])))
                    break
                if t in place:
                    low[node] = min(low[node], order[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    at = place[node]
                    members, held[at:] = held[at:], []
                    for m in members:
                        del place[m]
                    component.update(dict.fromkeys(members, min(members)))
    return component


def _solved(frame: pd.DataFrame) -> pd.DataFrame:
    import pandas as pd

    found = tarjan(list(zip(frame["a"].tolist(), frame["b"].tolist(), strict=True)))
    return pd.DataFrame({"node": list(found), "scc": list(found.values())}, dtype="int64")


def strong_components(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """edges(a long, b long) -> (node, scc): the smallest node of each strongly connected component of two nodes or more.

    After trimming, a large graph is cut between islands of its order (``within_islands``). Each weakly connected component of
    at most ``most`` edges is solved in one task, small ones together; what is larger is contracted first (``contracted``).
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("scc")).distinct()
    core = trimmed(edges.filter("a <> b").distinct())
    size = core.count()
    if size > min(most, ONE_TASK):
        whole, core = core, written(within_islands(core), "graph-islands")
        discard(whole)
    weak = connected_components(core)
    placed = written(core.join(weak.withColumnRenamed("node", "a"), "a"), "graph-placed")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    together = F.pmod(F.xxhash64("component"), F.lit(size // CLUSTER_EDGES + 1))
    small = placed.join(sizes.filter(F.col("size") <= most), "component").groupBy(together.alias("together")).applyInPandas(_solved, "node long, scc long")
    large = sizes.filter(F.col("size") > most)
    found = small if large.isEmpty() else small.unionByName(contracted(placed.join(large.select("component"), "component").select("a", "b"), most))
    several = found.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("scc")
    cycles = found.join(several, "scc").select("node", "scc")
    return cycles.unionByName(loops.join(cycles.select("node"), "node", "left_anti"))


def within_islands(edges: DataFrame) -> DataFrame:
    """Without edges that no cycle holds, by the nodes' order alone: a cycle that passes a place between two numbers upwards
    comes back over it, so where no edge leads down over a place, no component reaches over it. Nodes between two such places are an
    island, and only edges within one are kept.

    The nodes are sorted in ranges, and the driver gets a row a range, twice; so an order that follows the edges cuts a layered graph of
    any length at once, and any other order costs a few passes.
    """
    down = edges.filter("a > b").groupBy(F.col("b").alias("node")).agg(F.max("a").alias("reach"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(down, "node", "left")
    ranged = written(nodes.repartitionByRange("node").select("node", F.coalesce("reach", "node").alias("reach"), F.spark_partition_id().alias("part")), "graph-ranges")
    own = Window.partitionBy("part").orderBy("node")

    def carried(rows: DataFrame, value: F.Column) -> DataFrame:
        """rows with the largest value of all ranges before theirs."""
        out, largest = [], None
        for r in sorted(rows.groupBy("part").agg(F.max(value).alias("v")).collect(), key=lambda r: r.part):
            out.append((r.part, largest))
            largest = max((v for v in (largest, r.v) if v is not None), default=None)
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(out, "part int, carried long")), "part")

    before = F.greatest("carried", F.max("reach").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    begun = written(carried(ranged, F.col("reach")).select("node", "part", F.when(before.isNull() | (F.col("node") > before), F.col("node")).alias("begin")), "graph-ranges")
    island = F.coalesce(F.last("begin", ignorenulls=True).over(own), "carried")
    placed = written(carried(begun, F.col("begin")).select("node", island.alias("island")), "graph-ranges")
    discard(ranged, begun)
    of = lambda c, name: placed.select(F.col("node").alias(c), F.col("island").alias(name))
    return edges.join(of("a", "island"), "a").join(of("b", "other"), "b").filter("island = other").select("a", "b")


#: Of a cluster that one task contracts: its edges at most, one head among so many nodes, and steps that a head reaches.
CLUSTER_EDGES, HEADS, REACH = 100_000, 12, 3


def contracted(edges: DataFrame, most: int) -> DataFrame:
    """(node, scc) of a graph that is too large for a task, by making it smaller without losing a cycle.

    A round trims, replaces chains by edges (``_without_chains``) and merges the components that lie inside of clusters
    around random heads (``_merged_in_clusters``), each of which a task finds. Rounds go on until ``most`` edges are left for
    one task, or until they hardly help; then labels are passed over what is left (``coloured``). Afterwards the steps are
    undone backwards: a merged node is where its head is, a node of a chain is where both of the chain's ends are, if that is
    one place, and else alone. Rounds don't grow with the length of chains.
    """
    steps: list[tuple[str, DataFrame]] = []
    all_nodes = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "graph-nodes")
    left, size, turn = trimmed(edges), None, 0
    while True:
        before, size = size, left.count()
        if size <= max(most, 1) or (before is not None and size > 0.9 * before):
            break
        left, chains, rings = _without_chains(left)
        left, merged = _merged_in_clusters(trimmed(left), turn)
        left = trimmed(left)
        steps += [("merge", rings), ("chain", chains), ("merge", merged)]
        turn += 1
    rest = left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_solved, "node long, scc long") if size <= max(most, 1) else coloured(left)
    labels = written(rest, "graph-labels")
    at = lambda node, name: labels.select(F.col("node").alias(node), F.col("scc").alias(name))
    for kind, rows in reversed(steps):
        if kind == "merge":
            new = rows.join(at("head", "far"), "head", "left").select("node", F.coalesce("far", "head").alias("scc"))
            heads = rows.select(F.col("head").alias("node"), F.col("head").alias("scc")).distinct().join(labels, "node", "left_anti")
            new = new.unionByName(heads)
        else:
            both = rows.join(at("u", "su"), "u", "left").join(at("w", "sw"), "w", "left")
            su, sw = F.coalesce("su", "u"), F.coalesce("sw", "w")
            new = both.filter(su == sw).select("node", su.alias("scc"))
            ends = both.filter(su == sw).select(F.col("u").alias("node"), su.alias("scc")).distinct()
            new = new.unionByName(ends.join(labels, "node", "left_anti"))
        old, labels = labels, written(labels.unionByName(new), "graph-labels")
        discard(old, rows)
    least = labels.groupBy("scc").agg(F.min("node").alias("least"))
    own = labels.join(least, "scc").select("node", F.col("least").alias("scc"))
    return all_nodes.join(own, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def _without_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with each chain of nodes that have one edge in and one out replaced by one edge; chains(node, u, w): its nodes
    and the nodes before and after it; rings(node, head): chains that are closed. Chains are found as components, in
    logarithmic rounds."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(None).cast("long").alias("before"), F.col("b").alias("after")), F.struct(F.col("b").alias("node"), F.col("a").alias("before"), F.lit(None).cast("long").alias("after")))).alias("s"))
    by = sides.groupBy("s.node").agg(F.count("s.before").alias("into"), F.count("s.after").alias("out"), F.max("s.before").alias("before"), F.max("s.after").alias("after"))
    inner = written(by.filter("into = 1 and out = 1").select("node", "before", "after"), "graph-chain-nodes")
    is_inner = lambda c, flag: inner.select(F.col("node").alias(c), F.lit(True).alias(flag))
    marked = inner.join(is_inner("before", "follows"), "before", "left").join(is_inner("after", "leads"), "after", "left")
    linked = connected_components(marked.filter("leads").select(F.col("node").alias("a"), F.col("after").alias("b")), "graph-chains")
    placed = marked.join(linked, "node", "left").withColumn("chain", F.coalesce("component", "node"))
    ends = placed.groupBy("chain").agg(F.max(F.when(F.col("follows").isNull(), F.col("before"))).alias("u"), F.max(F.when(F.col("leads").isNull(), F.col("after"))).alias("w"))
    members = written(placed.select("node", "chain").join(ends, "chain"), "graph-chains")
    kept = edges.join(inner.select(F.col("node").alias("a")), "a", "left_anti").join(inner.select(F.col("node").alias("b")), "b", "left_anti")
    short = written(kept.unionByName(members.filter("u <> w").select(F.col("u").alias("a"), F.col("w").alias("b"))).distinct(), "graph-short")
    chains = written(members.filter("u is not null").select("node", "u", "w"), "graph-chain-steps")
    rings = written(members.filter("u is null and node <> chain").select("node", F.col("chain").alias("head")), "graph-rings")
    discard(inner, members)
    return short, chains, rings


def _merged_in_clusters(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Edges between what is left after each strongly connected component within a cluster became its smallest node, and
    merged(node, head). A cluster holds what a head reaches first in a few steps, whatever the direction."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lot = F.xxhash64("node", F.lit(turn))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    near = written(nodes.withColumn("cluster", F.when(F.pmod(lot, F.lit(HEADS)) == 0, F.col("node"))), "graph-clusters")
    for _ in range(REACH):
        offered = both.join(near.filter("cluster is not null").withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min_by("cluster", F.xxhash64("cluster", F.lit(turn))).alias("offered"))
        old, near = near, written(near.join(offered, "node", "left").select("node", F.coalesce("cluster", "offered").alias("cluster")), "graph-clusters")
        discard(old)
    of = lambda c, name: near.filter("cluster is not null").select(F.col("node").alias(c), F.col("cluster").alias(name))
    within = edges.join(of("a", "cluster"), "a").join(of("b", "other"), "b").filter("cluster = other").select("cluster", "a", "b")
    within = written(within, "graph-within")
    fit = within.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= CLUSTER_EDGES).select("cluster")
    found = within.join(fit, "cluster").groupBy("cluster").applyInPandas(_solved, "node long, scc long")
    merged = written(found.filter("node <> scc").select("node", F.col("scc").alias("head")), "graph-merged")
    to = lambda c: merged.select(F.col("node").alias(c), F.col("head").alias(f"{c}_head"))
    moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_head", "a").alias("a"), F.coalesce("b_head", "b").alias("b"))
    out = written(moved.filter("a <> b").distinct(), "graph-moved")
    discard(near, within)
    return out, merged


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(node, label): the smallest label of all nodes that reach a node over the edges, to a fixpoint."""
    while True:
        better = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        new = written(labels.join(better, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), (F.col("near") < F.col("label")).alias("moved")), "graph-labels")
        if new.filter("moved").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def coloured(edges: DataFrame) -> DataFrame:
    """(node, scc) by forward and backward labels: a node is with the root of its colour if it also reaches it."""
    parts: list[DataFrame] = []
    while not edges.isEmpty():
        nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colour = _spread(edges, nodes.withColumn("label", F.col("node")))
        of = lambda c, n, colour=colour: colour.select(F.col("node").alias(c), F.col("label").alias(n))
        within = written(edges.join(of("a", "ca"), "a").join(of("b", "cb"), "b").filter("ca = cb").select("a", "b", "ca"), "graph-within")
        # backward from the roots, inside of their colours
        reach = _spread(within.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.select("node", F.when(F.col("node") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).alias("label")))
        done = written(colour.join(reach.filter("label = 0").select("node"), "node", "left_semi").select("node", F.col("label").alias("scc")), "graph-done")
        parts.append(done)
        rest = within.join(done.select(F.col("node").alias("a")), "a", "left_anti").join(done.select(F.col("node").alias("b")), "b", "left_anti")
        edges = written(rest.select("a", "b"), "graph-rest")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cycles(edges: DataFrame) -> DataFrame:
    """edges(src string, ord, dst string) -> scc, files (sorted), chain (from the first file, edges in their order, the
    first path back to it): one row per cycle."""
    plain, nodes = numbered(edges)
    member = strong_components(plain).join(nodes, "node").select("name", "scc")
    of = lambda c, n: member.select(F.col("name").alias(c), F.col("scc").alias(n))
    inside = edges.join(of("src", "scc"), "src").join(of("dst", "other"), "dst").filter("scc = other").select("scc", "src", "ord", "dst")

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        rows = frame.sort_values(["src", "ord", "dst"])
        out: dict[str, list[str]] = {}
        for s, d in zip(rows["src"], rows["dst"], strict=True):
            out.setdefault(s, []).append(d)
        files = sorted(out)
        path, seen, work = [files[0]], {files[0]}, [iter(out[files[0]])]
        while work:
            for t in work[-1]:
                if t == files[0]:
                    return pd.DataFrame({"scc": [frame["scc"].iloc[0]], "files": [files], "chain": [[*path, t]]})
                if t not in seen:
                    seen.add(t)
                    path.append(t)
                    work.append(iter(out.get(t, [])))
                    break
            else:
                work.pop()
                path.pop()
        raise AssertionError("a component without a way back")

    return inside.groupBy("scc").applyInPandas(chain, "scc long, files array<string>, chain array<string>")
