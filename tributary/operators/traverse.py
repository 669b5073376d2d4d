"""Traversal: closures, bounded walks, layering, paths. Fixpoints are loops of joins that start from written tables.

Every round reads the frontier and the visited set from the shared folder, so the plan stays one round long and a lost
executor costs one round's tasks. A loop stops at an empty frontier, and fails loudly at its round limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.session import discard, numbered, settled, written

ROUNDS = 10_000


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def pruned(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``; what is left out never bridges."""
    kept = nodes.select("unique_id")
    return edges.join(kept, F.col("parent") == F.col("unique_id"), "left_semi").join(kept, F.col("child") == F.col("unique_id"), "left_semi")


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None = None, keep_seeds: bool = False) -> DataFrame:
    """(seed, unique_id, depth) of all nodes that ``seeds`` (seed, unique_id) reach along ``edges``; depth is the least
    number of hops. A seed's own node is left out, even on a cycle, unless ``keep_seeds`` (then at depth 0)."""
    edges = settled(edges, "walk-edges")
    start = written(seeds.select("seed", "unique_id").distinct().withColumn("depth", F.lit(0)), "walk")
    frontier, levels = start, [start]
    for level in range(1, (depth if depth is not None else ROUNDS) + 1):
        steps = frontier.join(edges, F.col("unique_id") == F.col("parent")).select("seed", F.col("child").alias("unique_id")).distinct()
        visited = levels[0]
        for part in levels[1:]:
            visited = visited.unionByName(part)
        frontier = written(steps.join(visited, ["seed", "unique_id"], "left_anti").withColumn("depth", F.lit(level)), "walk")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > 16:  # keep the union short on deep graphs
            merged = levels[0]
            for part in levels[1:]:
                merged = merged.unionByName(part)
            merged = written(merged, "walk")
            discard(*levels[:-1])
            levels = [merged]
    else:
        if depth is None:
            raise RuntimeError(f"the walk goes on after {ROUNDS} rounds")
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out if keep_seeds else out.where("depth > 0")


def closure(edges: DataFrame, seeds: DataFrame, direction: str = "down", depth: int | None = None, keep_seeds: bool = False) -> DataFrame:
    """(unique_id, depth) of what the set ``seeds`` (unique_id) reaches. With several seeds one that another reaches is
    still a seed, so it is left out; ask ``walk`` for each seed's own closure."""
    along = edges if direction == "down" else turned(edges)
    from_ = seeds.select(F.lit(1).alias("seed"), "unique_id")
    return walk(along, from_, depth, keep_seeds).select("unique_id", "depth")


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, up: bool = True, down: bool = True, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes around ``seeds`` on the chosen sides, the seeds included, and the edges among them."""
    found = seeds.select("unique_id")
    for wanted, side in ((up, "up"), (down, "down")):
        if wanted:
            found = found.unionByName(closure(edges, seeds, side, depth).select("unique_id"))
    found = written(found.distinct(), "subgraph")
    kept = nodes.join(found, "unique_id", "left_semi")
    return kept, pruned(edges, kept)


def layering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(unique_id, col): roots 0, every other node one more than its highest parent.

    Nodes are peeled off: each round places those whose parents are all placed, so there are as many rounds as layers and an
    edge is used once. What is left when nothing can be placed is on or below a cycle. There the longest path has no end;
    such nodes get the column that as many rounds as there are nodes would push them to: nodes + 1."""
    left = settled(pruned(edges.select("parent", "child"), nodes), "layering-edges")
    open_ = written(nodes.select("unique_id"), "layering")
    done = None
    for col in range(ROUNDS):
        # merged, as the driver would broadcast millions of ids by the size of their compressed file
        ready = written(open_.hint("merge").join(left.select(F.col("child").alias("unique_id")).distinct(), "unique_id", "left_anti"), "layering")
        if ready.isEmpty():
            break
        rest = open_.hint("merge").join(ready, "unique_id", "left_anti")
        placed = ready.withColumn("col", F.lit(col))
        done = placed if done is None else done.unionByName(placed)
        open_ = written(rest, "layering")
        if open_.isEmpty():
            break
        left = written(left.hint("merge").join(ready.withColumnRenamed("unique_id", "parent"), "parent", "left_anti"), "layering-edges")
    stuck = open_.withColumn("col", F.lit(nodes.count() + 1)) if not open_.isEmpty() else None
    out = done if stuck is None else stuck if done is None else done.unionByName(stuck)
    return out if out is not None else nodes.select("unique_id", F.lit(0).alias("col"))


def longest_chains(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(unique_id, weight, hops, next): from each node the chain downwards with the greatest weight, then the most
    hops, then the smallest next node. Without ``weight`` (a column of ``nodes``) only hops count. Acyclic graphs."""
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)
    edges = settled(edges, "chain-edges")
    base = written(nodes.select("unique_id", own.alias("own")), "chains")
    now = base.select("unique_id", F.col("own").alias("weight"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("next"))
    for _ in range(ROUNDS):
        now = written(now, "chains")
        ahead = edges.join(now, F.col("child") == F.col("unique_id")).select("parent", "weight", "hops", "child")
        ranked = ahead.groupBy("parent").agg(F.max(F.struct("weight", "hops")).alias("best"))
        best = (
            ahead.join(ranked, "parent").where("weight = best.weight and hops = best.hops").groupBy("parent")
            .agg(F.first("weight").alias("w"), F.first("hops").alias("h"), F.min("child").alias("next"))
        )
        nexts = base.join(best, F.col("unique_id") == F.col("parent"), "left").select(
            "unique_id", (F.col("own") + F.coalesce("w", F.lit(0.0))).alias("weight"), F.coalesce(F.col("h") + 1, F.lit(0)).alias("hops"), "next"
        )
        nexts = written(nexts, "chains")
        changed = nexts.alias("n").join(now.alias("o"), "unique_id").where("n.weight <> o.weight or n.hops <> o.hops or not (n.next <=> o.next)")
        now = nexts
        if changed.isEmpty():
            return now
    raise RuntimeError("chains still change: the graph has a cycle")


def longest_chain(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> list[str]:
    """The nodes of the best chain of all, ties to the smallest start. A chain is as long as the graph is deep; it is read
    by jumps of 1, 2, 4, ... nodes, so by few joins."""
    chains = longest_chains(nodes, edges, weight)
    first = chains.orderBy(F.desc("weight"), F.desc("hops"), "unique_id").first()
    if first is None:
        return []
    jump = written(chains.where("next is not null").select("unique_id", "next"), "jump")
    jumps = [jump]
    while (1 << len(jumps)) <= first["hops"]:
        to = jumps[-1].select(F.col("unique_id").alias("next"), F.col("next").alias("beyond"))
        jumps.append(written(jumps[-1].join(to, "next").select("unique_id", F.col("beyond").alias("next")), "jump"))
    on_path = chains.where(F.col("unique_id") == first["unique_id"]).select("unique_id")
    for jump in reversed(jumps):
        on_path = written(on_path.unionByName(on_path.join(jump, "unique_id").select(F.col("next").alias("unique_id"))).distinct(), "path")
    return [r["unique_id"] for r in chains.join(on_path, "unique_id", "left_semi").orderBy(F.desc("hops")).collect()]


def shortest_path(edges: DataFrame, start: str, cursor: str) -> list[str]:
    """A shortest undirected path, cursor first; among several, by breadth-first search over sorted edges: a node's
    predecessor is the one found first. Empty if there is none."""
    if start == cursor:
        return [cursor]
    spark = edges.sparkSession
    both = written(edges.select("parent", "child").unionByName(turned(edges)).distinct(), "path-edges")
    frontier = written(spark.createDataFrame([(start, 0)], "unique_id string, rank int"), "path")
    seen, previous = frontier.select("unique_id"), []
    for _ in range(ROUNDS):
        steps = frontier.join(both, F.col("unique_id") == F.col("parent")).join(seen.withColumnRenamed("unique_id", "child"), "child", "left_anti")
        found = steps.groupBy("child").agg(F.min(F.struct("rank", "parent")).alias("by"))
        # found first: by the predecessor's rank, then by name
        ranked = found.select(F.col("child").alias("unique_id"), F.col("by.parent").alias("before"), F.struct("by.rank", "child").alias("key"))
        keyed = written(ranked, "path")
        level = numbered(keyed.select("unique_id", "key", F.lit(0).alias("level")), ["level"], [F.col("key")], "rank")
        frontier = written(level.select("unique_id", "rank"), "path")
        if frontier.isEmpty():
            return []
        previous.append(keyed)
        seen = seen.unionByName(frontier.select("unique_id"))
        if not frontier.where(F.col("unique_id") == cursor).isEmpty():
            break
    path, at = [cursor], cursor
    for level in reversed(previous):
        at = level.where(F.col("unique_id") == at).first()["before"]
        path.append(at)
    return path


def path_edges(path: list[str], edges: DataFrame) -> DataFrame:
    """The edges between neighbours of ``path``, in their own direction."""
    pairs = edges.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(path, path[1:], strict=False))], "k int, a string, b string")
    on = ((F.col("parent") == F.col("a")) & (F.col("child") == F.col("b"))) | ((F.col("parent") == F.col("b")) & (F.col("child") == F.col("a")))
    return edges.join(F.broadcast(pairs), on).orderBy("k").select("parent", "child")


def collapse_siblings(nodes: DataFrame, edges: DataFrame, threshold: int = 8, priority: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Children are grouped by their deepest parent (ties: smallest uid). A group of more than ``threshold`` keeps its
    priority nodes, then the first by uid, and hides the rest behind one marker ``+<n> of <parent>``. Returns the nodes
    (unique_id, marker) and the edges contracted through markers. 0 collapses nothing."""
    if threshold <= 0:
        return nodes.select("unique_id", F.lit(None).cast("string").alias("marker")), edges
    depth = layering(nodes, edges)
    deepest = (
        edges.join(depth, F.col("parent") == F.col("unique_id")).groupBy("child")
        .agg(F.min(F.struct((-F.col("col")).alias("up"), "parent")).alias("best")).select(F.col("child").alias("unique_id"), F.col("best.parent").alias("anchor"))
    )
    wanted = (priority.select("unique_id") if priority is not None else nodes.select("unique_id").limit(0)).distinct().withColumn("first", F.lit(0))
    group = W.partitionBy("anchor")
    ranked = deepest.join(wanted, "unique_id", "left").withColumns({
        "first": F.coalesce("first", F.lit(1)),
        "rank": F.row_number().over(group.orderBy(F.coalesce("first", F.lit(1)), "unique_id")),
        "size": F.count("*").over(group),
    })
    shown = F.greatest(F.lit(threshold), F.count_if(F.col("first") == 0).over(group))
    hidden = ranked.withColumn("shown", shown).where((F.col("size") > threshold) & (F.col("rank") > F.col("shown")))
    marks = hidden.select("unique_id", F.concat(F.lit("+"), (F.col("size") - F.col("shown")).cast("string"), F.lit(" of "), "anchor").alias("marker"))
    marks = written(marks, "markers")
    to = lambda c: marks.select(F.col("unique_id").alias(c), F.col("marker").alias(f"{c}_marker"))
    contracted = edges.join(to("parent"), "parent", "left").join(to("child"), "child", "left").select(
        F.coalesce("parent_marker", "parent").alias("parent"), F.coalesce("child_marker", "child").alias("child")
    )
    return nodes.select("unique_id").join(marks, "unique_id", "left"), contracted.where("parent <> child").distinct()
