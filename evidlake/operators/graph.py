"""Graph records, checks and bounded traversals by frontier joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidlake.functions.identity import edge_id, node_id

DEPTH_MOST, SUBTREE_DEPTH, SUBTREE_NODES = 64, 32, 4096
HUB, BROADCAST_HUBS = 100_000, 10_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where that is unset, as in tests, a folder of this machine, which only a local master allows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="spark-evidlake-")).rstrip("/")


def numbered_seeds(seeds: DataFrame) -> DataFrame:
    """(seed, block, bit): 64 seeds to a block. Numbers are written once, as they depend on how the rows are dealt."""
    number = F.monotonically_increasing_id()
    return cut_lineage(seeds.select("seed").distinct().withColumn("number", number)).select("seed", F.shiftright("number", 6).alias("block"), F.expr("cast(number & 63 as int)").alias("bit"))


def reach_levels(steps: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, block, depth, bits): which seeds of a block are first reached from a node at a depth; ``steps``: step_from, step_to; ``seeds``: as ``numbered_seeds``.

    Breadth first for all seeds at once: a round joins the frontier to the edges that end in it, ORs the bits that come to a node, and drops those that the
    node has. A round has a row for each node and block at most. A node in which over ``HUB`` edges end has them dealt over several keys, and its
    frontier rows repeated for each.
    """
    ends = cut_lineage(steps.groupBy("step_to").agg((F.count("*") / HUB).cast("int").alias("deals")).where("deals > 0").select(F.col("step_to").alias("hub"), "deals"))
    hubs = F.broadcast(ends) if ends.count() <= BROADCAST_HUBS else ends
    dealt = steps.join(hubs, F.col("step_to") == F.col("hub"), "left")
    dealt = cut_lineage(dealt.select("step_from", "step_to", F.pmod(F.xxhash64("step_from"), F.coalesce("deals", F.lit(0)) + 1).cast("int").alias("deal")).distinct())
    frontier = cut_lineage(seeds.groupBy(F.col("seed").alias("node"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    seen, levels = frontier, frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        spread = frontier.join(hubs, F.col("node") == F.col("hub"), "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(0))))).select("node", "block", "bits", "deal")
        come = spread.join(dealt, (F.col("node") == F.col("step_to")) & spread["deal"].eqNullSafe(dealt["deal"])).groupBy(F.col("step_from").alias("node"), "block").agg(F.bit_or("bits").alias("come"))
        both = come.join(seen.withColumnRenamed("bits", "had"), ["node", "block"], "full_outer")
        had = F.coalesce("had", F.lit(0).cast("long"))
        both = cut_lineage(both.select("node", "block", had.alias("had"), F.coalesce("come", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(had)).alias("new")))
        frontier = both.where("new <> 0").select("node", "block", F.col("new").alias("bits"))
        if frontier.isEmpty():
            break
        seen = both.select("node", "block", F.col("had").bitwiseOR(F.col("new")).alias("bits"))
        levels = levels.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return levels.select("node", "block", "depth", "bits")


def _by_seed(rows: DataFrame, seeds: DataFrame, *columns: str) -> DataFrame:
    """A row for each seed whose bit is set in ``bits``, with those columns."""
    each = rows.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", F.col("bits"), b).bitwiseAND(F.lit(1).cast("long")) != 0)))
    return each.join(seeds, ["block", "bit"]).select("seed", *columns)


def reverse_reach(edges: DataFrame, seeds: DataFrame, max_depth: int, relations: tuple[str, ...] | None = None, via: bool = True) -> DataFrame:
    """(seed, node, depth, via_edge): nodes from which a seed is reached, with the edge of one shortest way; without ``via`` no edge is looked for.

    Seeds travel as bits (``reach_levels``); only the result has a row for each seed and node. Ties go to the least (source, edge, target): at
    each level an edge counts for the seeds whose bits its target had one level before.
    """
    if not 0 <= max_depth <= DEPTH_MOST:
        raise ValueError(f"max_depth must be within 0 and {DEPTH_MOST}")
    if relations is not None:
        edges = edges.where(F.col("relation").isin(*relations))
    steps = edges.select(F.col("source").alias("step_from"), F.col("target").alias("step_to"), "edge_id")
    numbers = numbered_seeds(seeds)
    levels = reach_levels(steps.drop("edge_id"), numbers, max_depth)
    if not via:
        return _by_seed(levels, numbers, "node", "depth")
    start = levels.where("depth = 0").withColumn("via_edge", F.lit(None).cast(edges.schema["edge_id"].dataType))
    before = levels.select(F.col("node").alias("step_to"), "block", (F.col("depth") + 1).alias("depth"), F.col("bits").alias("had"))
    ways = levels.where("depth > 0").join(steps, F.col("node") == F.col("step_from")).join(before, ["step_to", "block", "depth"])
    ways = ways.withColumn("bits", F.col("bits").bitwiseAND(F.col("had"))).where("bits <> 0")
    found = _by_seed(ways, numbers, "node", "depth", "edge_id", "step_to").groupBy("seed", "node", "depth").agg(F.min(F.struct("edge_id", "step_to")).alias("e"))
    return _by_seed(start, numbers, "node", "depth", "via_edge").unionByName(found.select("seed", "node", "depth", F.col("e.edge_id").alias("via_edge")))


def witnesses(reached: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(seed, node, depth, witness_edges): the edges of the way from node to seed, in order."""
    towards = edges.select(F.col("edge_id").alias("via"), F.col("target").alias("next"))
    rows = reached.select("seed", "node", "depth", F.col("node").alias("at"), F.array().cast(f"array<{reached.schema['via_edge'].dataType.simpleString()}>").alias("witness_edges"))
    way = reached.select(F.col("seed").alias("s"), F.col("node").alias("n"), "via_edge").join(towards, F.col("via_edge") == F.col("via"), "left").select("s", "n", "via_edge", "next")
    for k in range(max_depth):
        rows = rows.join(way, (F.col("seed") == F.col("s")) & (F.col("at") == F.col("n")), "left")
        rows = rows.select("seed", "node", "depth", F.coalesce("next", "at").alias("at"), F.when(F.col("via_edge").isNotNull(), F.concat("witness_edges", F.array("via_edge"))).otherwise(F.col("witness_edges")).alias("witness_edges"))
        if k % 4 == 3:
            rows = cut_lineage(rows)
    return rows.drop("at")


def subtree(edges: DataFrame, roots: DataFrame, max_depth: int, relations: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with depth below each root (seed), all edges that leave expanded nodes, and diagnostics for roots of too many nodes."""
    if not 0 <= max_depth <= SUBTREE_DEPTH:
        raise ValueError(f"max_depth must be within 0 and {SUBTREE_DEPTH}")
    turned = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_id", *[c for c in ("relation",) if c in edges.columns])
    nodes = cut_lineage(reverse_reach(turned, roots, max_depth, relations, via=False))
    over = nodes.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > SUBTREE_NODES).withColumn("diagnostic", F.lit("TOO_MANY_NODES"))
    nodes = nodes.join(over.select("seed"), "seed", "left_anti")
    kept = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    below = nodes.where(F.col("depth") < max_depth).join(kept, F.col("node") == F.col("source")).select("seed", "edge_id", "source", "target")
    return nodes, below.distinct(), over


def graph_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, id) of duplicate ids and edges without an endpoint."""
    twice = lambda df, c, code: df.groupBy(c).count().where("count > 1").select(F.lit(code).alias("code"), F.col(c).alias("id"))
    lost = lambda end: edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_anti").select(F.lit(f"MISSING_{end.upper()}").alias("code"), F.col("edge_id").alias("id"))
    return twice(nodes, "node_id", "DUPLICATE_NODE").unionByName(twice(edges, "edge_id", "DUPLICATE_EDGE")).unionByName(lost("source")).unionByName(lost("target"))


def contract_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, id) of records whose key is blank, id isn't derived from content, or confidence source is unknown."""
    n = nodes.select("node_id", F.when(F.trim("key") == "", "BLANK_KEY").when(F.col("node_id") != node_id(F.col("kind"), F.col("key")), "NODE_ID").alias("code"))
    e = edges.select("edge_id", F.when(F.col("edge_id") != edge_id(F.col("source"), F.col("relation"), F.col("target")), "EDGE_ID").when(~F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), "CONFIDENCE").alias("code"))
    return n.where("code is not null").select("code", F.col("node_id").alias("id")).unionByName(e.where("code is not null").select("code", F.col("edge_id").alias("id")))


def observation_records(routes: DataFrame, operations: DataFrame, invariants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations as graph records: route REFS handler, handler READS_FROM or WRITES_TO resource (none for a call), invariant nodes.

    Nodes (node_id, kind, key, n_evidence) and edges (edge_id, source, relation, target, n_evidence) count their evidence; its ids merge per record in the third table,
    (record_id, evidence_id), a row each, so a handler that everything touches is no list.
    """
    node = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("key"), "evidence_id")
    rows = node(routes, "ROUTE", F.col("route_id")).unionByName(node(routes, "HANDLER", F.col("handler"))).unionByName(node(operations, "HANDLER", F.col("handler"))).unionByName(node(operations, "RESOURCE", F.col("resource"))).unionByName(node(invariants, "INVARIANT", F.col("invariant_id")))
    rows = rows.distinct().withColumn("node_id", node_id(F.col("kind"), F.col("key")))
    nodes = rows.groupBy("node_id", "kind", "key").agg(F.count("evidence_id").alias("n_evidence"))
    to = lambda kind, key: node_id(F.lit(kind), F.col(key))
    refs = routes.select(to("ROUTE", "route_id").alias("source"), F.lit("REFS").alias("relation"), to("HANDLER", "handler").alias("target"), "evidence_id")
    relation = F.when(F.col("operation") == "READ", "READS_FROM").when(F.col("operation").isin("INSERT", "UPDATE", "UPSERT", "DELETE"), "WRITES_TO")
    uses = operations.withColumn("relation", relation).where("relation is not null").select(to("HANDLER", "handler").alias("source"), "relation", to("RESOURCE", "resource").alias("target"), "evidence_id")
    links = refs.unionByName(uses).distinct().withColumn("edge_id", edge_id(F.col("source"), F.col("relation"), F.col("target")))
    edges = links.groupBy("edge_id", "source", "relation", "target").agg(F.count("evidence_id").alias("n_evidence"))
    told = rows.select(F.col("node_id").alias("record_id"), "evidence_id").unionByName(links.select(F.col("edge_id").alias("record_id"), "evidence_id"))
    return nodes, edges, told.where("evidence_id is not null")


def graph_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    from evidlake.operators.deltas import record_diff

    return record_diff(before, after, key, digest)


def finding_context(findings: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(finding_id, symbol, state) of findings' symbol subjects (subjects: array of ``symbol:<key>``): ADDED, REMOVED, MODIFIED, UNCHANGED or UNRESOLVED between node tables (key, digest)."""
    rows = findings.select("finding_id", F.explode("subjects").alias("s")).where(F.col("s").startswith("symbol:")).select("finding_id", F.substring("s", 8, 4096).alias("key"))
    rows = rows.join(before.select("key", F.col("digest").alias("was")), "key", "left").join(after.select("key", F.col("digest").alias("now")), "key", "left")
    was, now = F.col("was"), F.col("now")
    state = F.when(was.isNull() & now.isNull(), "UNRESOLVED").when(was.isNull(), "ADDED").when(now.isNull(), "REMOVED").when(was != now, "MODIFIED").otherwise("UNCHANGED")
    return rows.select("finding_id", F.col("key").alias("symbol"), state.alias("state"))


def ranked(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
