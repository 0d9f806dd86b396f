"""Graphs as edge frames: an edge src -> dst says that src depends on dst.

Closure, longest paths, components and ranks are loops over frames whose rounds are written
tables.  Order-bound algorithms (betweenness, communities, schedules) run as grouped tasks, one for
each scenario or block of sources, on a graph whose size is checked first.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.storage import written

#: edges that one task may hold; beyond that the grouped operators refuse
TASK_EDGES = 2_000_000
#: edges up to which longest chains are found in one task rather than round by round
FEW_EDGES = 200_000


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs with a path, but a node with itself.

    Each round doubles the length of the paths that are known: what the last round found is joined
    with all that is known, so rounds grow with the logarithm of the depth, and each writes only
    what it found."""
    new = written(edges.select("src", "dst").where("src <> dst").distinct(), "closure")
    total = new
    while True:
        step = new.withColumnRenamed("dst", "mid").join(total.withColumnRenamed("src", "mid"), "mid").select("src", "dst").where("src <> dst").distinct()
        new = written(step.join(total, ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return total
        total = total.union(new)


def longest(nodes: DataFrame, edges: DataFrame, cost: str | None = None, few: int = FEW_EDGES) -> DataFrame:
    """(node, level, finish): the longest chain of dependencies below each node, in edges and in cost.

    A graph of `few` edges and nodes or less, as counted, is one task's work.  In a larger one each round settles the nodes all of whose dependencies are settled, so a node is joined once for
    each edge; what is left without one that can be settled is a cycle and raises ValueError."""
    every = nodes.select("node", (F.coalesce(cost, F.lit(0)) if cost else F.lit(1)).cast("long").alias("cost"))
    e = written(edges.select("src", "dst").distinct(), "edges")
    if e.limit(few + 1).count() <= few and every.limit(few + 1).count() <= few:
        return _longest_in_task(every, e)
    left = written(every, "left")
    done = best = None
    while True:
        blocked = e.select(F.col("src").alias("node")).distinct()
        ready = left.join(blocked, "node", "left_anti")
        if done is None:
            fresh = ready.select("node", F.lit(0).alias("level"), F.col("cost").alias("finish"))
        else:
            fresh = ready.join(best, "node", "left").select("node", F.coalesce(F.col("level") + 1, F.lit(0)).alias("level"), (F.col("cost") + F.coalesce("finish", F.lit(0))).alias("finish"))
        fresh = written(fresh, "fresh")
        if fresh.isEmpty():
            if not left.isEmpty():
                raise ValueError(f"the graph has a cycle among {sorted(r[0] for r in left.limit(5).collect())}")
            return done if done is not None else fresh
        done = fresh if done is None else done.union(fresh)
        reached = e.join(fresh.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.max("level").alias("level"), F.max("finish").alias("finish"))
        best = reached if best is None else best.union(reached).groupBy("node").agg(F.max("level").alias("level"), F.max("finish").alias("finish"))
        best = written(best, "best")
        left = written(left.join(fresh, "node", "left_anti"), "left")
        e = written(e.join(fresh.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")


def _longest_in_task(every: DataFrame, edges: DataFrame) -> DataFrame:
    def one(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        deps, own = defaultdict(list), dict(zip(n["node"], n["cost"]))
        for a, b in zip(e["src"], e["dst"]):
            deps[a].append(b)
        level, finish = {}, {}
        for x in kernels.order(list(own), deps):
            level[x] = max((level[d] + 1 for d in deps[x]), default=0)
            finish[x] = own[x] + max((finish[d] for d in deps[x]), default=0)
        return pd.DataFrame({"node": list(level), "level": list(level.values()), "finish": list(finish.values())})

    kind = every.schema["node"].dataType.simpleString()
    key = F.lit(0).alias("one")
    return every.select(key, "*").groupBy("one").cogroup(edges.select(key, "*").groupBy("one")).applyInPandas(lambda n, e: one(n, e), f"node {kind}, level int, finish long")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(src, dst, src_layer, dst_layer, violation) of the edges that do not lead to a lower layer(node, layer): lateral within one, else upward; ends without a layer are left out."""
    at = lambda end: layers.select(F.col("node").alias(end), F.col("layer").alias(f"{end}_layer"))
    e = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").where("dst_layer >= src_layer")
    return e.select("src", "dst", "src_layer", "dst_layer", F.when(F.col("src_layer") == F.col("dst_layer"), "lateral").otherwise("upward").alias("violation"))


def critical_path(nodes: DataFrame, edges: DataFrame, cost: str = "ms") -> DataFrame:
    """(node, cost, start, finish, slack, critical): earliest times, and how far each node can slip."""
    down, up = longest(nodes, edges, cost), longest(nodes, reverse(edges), cost)
    both = down.select("node", "finish").join(up.select("node", F.col("finish").alias("tail")), "node").join(nodes.select("node", F.coalesce(cost, F.lit(0)).cast("long").alias("cost")), "node")
    total = both.agg(F.max("finish").alias("total"))
    slack = F.col("total") - F.col("finish") - F.col("tail") + F.col("cost")
    return both.crossJoin(F.broadcast(total)).select("node", "cost", (F.col("finish") - F.col("cost")).alias("start"), "finish", slack.alias("slack"), (slack == 0).alias("critical"))


def length(nodes: DataFrame, edges: DataFrame, cost: str = "ms") -> int:
    return longest(nodes, edges, cost).agg(F.max("finish")).head()[0] or 0


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes.select("node").join(out, "node", "left").join(into, "node", "left").na.fill(0).select("node", "in_degree", "out_degree")


def reach(nodes: DataFrame, edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Direct and transitive dependencies and dependants of each node."""
    pairs = closure(edges) if pairs is None else pairs
    deps = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("transitive_dependencies"))
    users = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("transitive_dependants"))
    return degrees(nodes, edges).join(deps, "node", "left").join(users, "node", "left").na.fill(0)


def rebuild_cost(nodes: DataFrame, edges: DataFrame, cost: str = "ms", pairs: DataFrame | None = None) -> DataFrame:
    """Own cost and that of all that depends on the node."""
    pairs = closure(edges) if pairs is None else pairs
    more = pairs.join(nodes.select(F.col("node").alias("src"), F.col(cost).alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("c").alias("more"))
    return nodes.join(more, "node", "left").select("node", (F.coalesce(cost, F.lit(0)) + F.coalesce("more", F.lit(0))).alias("rebuild_ms"))


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, and the ends of edges that are not among them, their other columns null."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.unionByName(ends, allowMissingColumns=True)


def build_graph(nodes: DataFrame, edges: DataFrame, direct_only: bool = True, acyclic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a dependency graph: direct edges alone unless asked otherwise, each once, ends that are no known node added; a cycle raises ValueError."""
    kept = edges.where("is_direct") if direct_only and "is_direct" in edges.columns else edges
    kept = kept.dropDuplicates(["src", "dst"])
    nodes = with_endpoints(nodes, kept)
    if acyclic and not is_acyclic(nodes, kept):
        raise ValueError("the dependency graph has a cycle")
    return nodes, kept


def is_acyclic(nodes: DataFrame, edges: DataFrame) -> bool:
    try:
        longest(nodes, edges).count()
        return True
    except Exception as e:  # the cycle is found where the chains are followed, in a task or here
        if "has a cycle" not in str(e):
            raise
        return False


def centrality(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """(node, in_degree, out_degree, betweenness, pagerank)."""
    return degrees(nodes, edges).join(betweenness(nodes, edges), "node").join(pagerank(nodes, edges, **how).withColumnRenamed("rank", "pagerank"), "node")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: size, density, kinds, depth and degrees of a graph of nodes(node, kind); depth is null where there is a cycle."""
    acyclic = is_acyclic(nodes, edges)
    d = degrees(nodes, edges).join(nodes.select("node", "kind"), "node")
    n, m = F.count("*"), F.sum("out_degree")
    out = d.agg(
        n.alias("nodes"), m.alias("edges"), F.when(n > 1, m / (n * (n - 1.0))).otherwise(0.0).alias("density"), F.count_if(F.col("kind") == "executable").alias("executables"), F.count_if(F.contains("kind", F.lit("library"))).alias("libraries"),
        F.avg("in_degree").alias("mean_in"), F.avg("out_degree").alias("mean_out"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"),
    )
    deep = longest(nodes, edges).agg(F.max("level").cast("long").alias("max_depth")) if acyclic else nodes.limit(0).agg(F.max(F.lit(0)).cast("long").alias("max_depth"))
    return out.crossJoin(F.broadcast(deep)).withColumn("is_dag", F.lit(acyclic))  # one row


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable when direction is ignored."""
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "links")
    label = written(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        seen = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        near = label.join(seen, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("mid"))
        new = written(near.join(label.select(F.col("node").alias("mid"), F.col("component").alias("far")), "mid").select("node", "old", F.least("mid", "far").alias("component")), "labels")
        label = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return label


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, weight: str | None = None, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, rank) once the ranks' changes add up to less than tolerance times the nodes, or after so many rounds; nodes without a way out spread their rank evenly.

    Every round is written, so no round is worked out twice."""
    n = nodes.count()
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    e = written(e.join(e.groupBy("src").agg(F.sum("w").alias("s")), "src").select("src", "dst", (F.col("w") / F.col("s")).alias("w")), "ways")
    sources = written(e.select(F.col("src").alias("node")).distinct(), "sources")
    rank = written(nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank")), "rank")
    for _ in range(rounds):
        loose = rank.join(sources, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        into = rank.join(e.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("in"))
        new = rank.join(into, "node", "left").crossJoin(F.broadcast(loose))  # one row
        new = written(new.select("node", F.col("rank").alias("old"), ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + F.col("loose") / n)).alias("rank")), "rank")
        rank = new.select("node", "rank")
        if tolerance is not None and (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).head()[0] or 0.0) < n * tolerance:
            break
    return rank


def _adjacency(edges: DataFrame) -> list[tuple]:
    """The edges on the driver, for a broadcast: within TASK_EDGES, or it refuses."""
    n = edges.count()
    if n > TASK_EDGES:
        raise ValueError(f"{n} edges are more than one task may hold ({TASK_EDGES})")
    return [tuple(r) for r in edges.collect()]


def betweenness(nodes: DataFrame, edges: DataFrame, blocks: int = 64) -> DataFrame:
    """(node, betweenness): exact; blocks of sources run side by side over a broadcast graph of checked size."""
    spark = nodes.sparkSession
    held = spark.sparkContext.broadcast(_adjacency(edges.select("src", "dst").distinct()))
    n = nodes.count()

    def block(batches):
        succ = defaultdict(list)
        for a, b in held.value:
            succ[a].append(b)
        total: dict = defaultdict(float)
        for pdf in batches:
            for s in pdf["node"]:
                paths, dist, seen, before = {s: 1}, {s: 0}, [s], defaultdict(list)
                for v in seen:
                    for w in succ.get(v, ()):
                        if w not in dist:
                            dist[w], paths[w] = dist[v] + 1, 0
                            seen.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = dict.fromkeys(seen, 0.0)
                for w in reversed(seen):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] += share[w]
        if total:
            yield pd.DataFrame({"node": pd.Series(list(total), dtype=object), "part": list(total.values())})

    kind = nodes.schema["node"].dataType.simpleString()
    parts = nodes.select("node").repartition(blocks, "node").mapInPandas(block, f"node {kind}, part double")
    total = parts.groupBy("node").agg(F.sum("part").alias("part"))
    scale = float((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.select("node").join(total, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) / scale if scale else F.lit(0.0)).alias("betweenness"))


def communities(nodes: DataFrame, edges: DataFrame, weight: str = "weight", resolution: float = 1.0) -> DataFrame:
    """(node, community) by Louvain's method in one task, on a graph of checked size; the smallest member names a community."""
    spark = nodes.sparkSession
    pairs = _adjacency(edges.select("src", "dst", F.col(weight).cast("double")))
    held = spark.sparkContext.broadcast(pairs)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = kernels.communities(sorted(pdf["node"]), held.value, resolution)
        name: dict = {}
        for n in sorted(found):
            name.setdefault(found[n], n)
        return pd.DataFrame({"node": list(found), "community": [name[g] for g in found.values()]})

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select(F.lit(0).alias("one"), "node").groupBy("one").applyInPandas(one, f"node {kind}, community {kind}")


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: Newman's modularity of parts(node, part) over undirected edges, and the share of edges between parts."""
    e = edges.select("src", "dst").join(parts.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst")
    total = e.agg(F.count("*").alias("m"), F.count_if(F.col("a") != F.col("b")).alias("between"))
    inside = e.where("a = b").groupBy(F.col("a").alias("part")).agg(F.count("*").alias("l"))
    degree = e.select(F.explode(F.array("a", "b")).alias("part")).groupBy("part").agg(F.count("*").alias("d"))
    by = degree.join(inside, "part", "left").crossJoin(F.broadcast(total))
    q = F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2))
    return by.agg(q.alias("modularity"), (F.max("between") / F.max("m")).alias("between_fraction"), F.count("*").alias("parts"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two partitions (node, part)."""
    both = a.select("node", F.col("part").alias("a")).join(b.select("node", F.col("part").alias("b")), "node")
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("t"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    ha = rows.crossJoin(F.broadcast(total)).agg(F.sum(two("ra")).alias("sa"), F.sum(-(F.col("ra") / F.col("t")) * F.log(F.col("ra") / F.col("t"))).alias("ha"))
    hb = cols.crossJoin(F.broadcast(total)).agg(F.sum(two("cb")).alias("sb"), F.sum(-(F.col("cb") / F.col("t")) * F.log(F.col("cb") / F.col("t"))).alias("hb"))
    full = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    out = full.agg(F.sum(two("n")).alias("s"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).alias("mi"), F.max("t").alias("t")).crossJoin(F.broadcast(ha)).crossJoin(F.broadcast(hb))
    expected = F.col("sa") * F.col("sb") / two("t")
    return out.select(((F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"), (F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


#: kinds of targets that take no part in a chain's weight, and those that are linked
PHONY, LINKED = ("interface_library", "custom_target"), ("executable", "shared_library", "module_library")


def chain_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, weight): how many nodes that are no phony kind the longest chain of dependencies from a node has, itself included."""
    kind = nodes.columns
    own = F.when(F.col("kind").isin(*PHONY), 0).otherwise(1) if "kind" in kind else F.lit(1)
    return longest(nodes.select("node", own.alias("own")), edges, "own").select("node", F.col("finish").alias("weight"))


def pools(nodes: DataFrame, link_depth: int) -> DataFrame:
    """(node, pool): the nodes' own pool column, or link_pool for linked kinds if that has a depth; default for the rest."""
    if "pool" in nodes.columns:
        return nodes.select("node", F.coalesce("pool", F.lit("default")).alias("pool"))
    linked = F.col("kind").isin(*LINKED) if "kind" in nodes.columns and link_depth > 0 else F.lit(False)
    return nodes.select("node", F.when(linked, "link_pool").otherwise("default").alias("pool"))


def with_dependencies(nodes: DataFrame, edges: DataFrame, seed: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of seed(node) and all that they depend on, and the edges among these."""
    pairs = closure(edges) if pairs is None else pairs
    inside = written(seed.select("node").union(pairs.join(seed.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))).distinct(), "inside")
    left = edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi").join(inside.select(F.col("node").alias("dst")), "dst", "left_semi")
    return nodes.join(inside, "node", "left_semi"), left.select(*edges.columns)


def simulate(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, cost: str = "ms", target=None, scope: DataFrame | None = None) -> DataFrame:
    """(scenario, node, start_ms, end_ms, core) of a list schedule for each scenario(scenario, cores, and link_depth if links are pooled); scenarios run side by side.

    With a target, it and its dependencies alone are built; with a scope(node), its nodes.  Both at
    once raise ValueError, an unknown target KeyError."""
    if target is not None and scope is not None:
        raise ValueError("a target and a scope exclude each other")
    if target is not None:
        seed = nodes.where(F.col("node") == target).select("node")
        if seed.isEmpty():
            raise KeyError(target)
        nodes, edges = with_dependencies(nodes, edges, seed)
    if scope is not None:
        nodes, edges = nodes.join(scope.select("node").distinct(), "node", "left_semi"), edges
    spark = nodes.sparkSession
    kind = F.col("kind") if "kind" in nodes.columns else F.lit(None).cast("string")
    pool = F.col("pool") if "pool" in nodes.columns else F.lit(None).cast("string")
    if nodes.limit(TASK_EDGES + 1).count() > TASK_EDGES:
        raise ValueError(f"a schedule is one task's work, of {TASK_EDGES} targets at most")
    rows = nodes.select("node", F.coalesce(cost, F.lit(0)).cast("long"), kind, pool).collect()
    times = {r[0]: r[1] for r in rows}
    deps = defaultdict(list)
    for a, b in _adjacency(edges.select("src", "dst").distinct()):
        if a in times and b in times:
            deps[a].append(b)
    phony = {r[0] for r in rows if r[2] in PHONY}
    named = {r[0]: r[3] for r in rows if r[3] is not None}
    links = named if "pool" in nodes.columns else {r[0]: "link_pool" for r in rows if r[2] in LINKED}
    held = spark.sparkContext.broadcast((times, dict(deps), phony, links))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        times, deps, phony, links = held.value
        depth = int(pdf["link_depth"].iloc[0]) if "link_depth" in pdf else 0
        plan = kernels.schedule(times, deps, int(pdf["cores"].iloc[0]), links, {"link_pool": depth} if depth > 0 else {}, phony)
        return pd.DataFrame([(pdf["scenario"].iloc[0], *r) for r in plan], columns=["scenario", "node", "start_ms", "end_ms", "core"])

    name = nodes.schema["node"].dataType.simpleString()
    return scenarios.groupBy("scenario").applyInPandas(one, f"scenario string, node {name}, start_ms long, end_ms long, core int")


def lengths_without(nodes: DataFrame, edges: DataFrame, asked: DataFrame, cost: str = "ms") -> DataFrame:
    """(src, dst, length_ms, without_ms) of the asked(src, dst) edges: the longest chain with all edges, and without that one.

    Chains go from a root down to a leaf, and levels fall along them, so a chain passes from the level
    of src or more to less just once.  Without the edge, the longest chain is that of another edge
    that passes there, one that ends in src, or one that lies below; the two best passing edges of
    each asked level tell."""
    at = longest(nodes, edges, cost)
    up = longest(nodes, reverse(edges), cost).select("node", F.col("finish").alias("tail"))
    at = written(at.join(up, "node"), "levels")
    total = at.agg(F.max("finish").alias("length_ms"))
    a = at.select(F.col("node").alias("src"), F.col("level").alias("la"), F.col("tail").alias("ta"))
    b = at.select(F.col("node").alias("dst"), F.col("level").alias("lb"), F.col("finish").alias("fb"))
    e = written(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").withColumn("long", F.col("ta") + F.col("fb")), "chains")
    asked = written(e.join(asked.select("src", "dst").distinct(), ["src", "dst"], "left_semi"), "asked")
    cuts = asked.select(F.col("la").alias("cut")).distinct()
    passing = e.select("src", "dst", "long", F.explode(F.sequence(F.col("lb") + 1, F.col("la"))).alias("cut")).join(cuts, "cut", "left_semi")
    # two best by level: the best chain, then the best of the edges other than its first
    best = passing.groupBy("cut").agg(F.max(F.struct("long", "src", "dst")).alias("top"))
    second = passing.join(best, "cut").where((F.col("src") != F.col("top.src")) | (F.col("dst") != F.col("top.dst"))).groupBy("cut").agg(F.max("long").alias("next"))
    by_level = at.groupBy("level").agg(F.max("finish").alias("best"))
    below = cuts.join(by_level, by_level["level"] < cuts["cut"]).groupBy("cut").agg(F.max("best").alias("below"))
    out = asked.withColumn("cut", F.col("la")).join(best, "cut").join(second, "cut", "left").join(below, "cut", "left").crossJoin(F.broadcast(total))
    own = (F.col("src") == F.col("top.src")) & (F.col("dst") == F.col("top.dst"))
    rest = F.when(own, F.col("next")).otherwise(F.col("top.long"))
    return out.select("src", "dst", "length_ms", F.greatest(rest, "ta", "below").alias("without_ms"))
