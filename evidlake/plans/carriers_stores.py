"""Registered queries of record tables: each writes a table of its own in the shared folder and returns what is in it afterwards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidlake.operators import graph
from evidlake.plans.carriers import ev, query, table
from evidlake.plans.carriers_more import tree_graph, versions
from evidlake.sources.store import RecordStore


def store(s, name, like, key, buckets=32):
    return RecordStore.create(s, f"{graph.shared_folder(s)}/{name}-{uuid.uuid4().hex}", like.schema, key, buckets)


def orders_store(s, d, immutable):
    """Orders with even keys first, then those whose key isn't divisible by 3, every fourth with other content."""
    new, held = versions(s, d)
    t = store(s, "orders", held, "o_orderkey")
    t.put(held, "digest")
    return t, t.put(new, "digest", immutable=immutable)


@query(
    "k1_store_insert",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'INSERTED' WHEN o_orderkey % 4 = 0 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS outcome, 1 AS revision
FROM orders WHERE o_orderkey % 3 <> 0
""",
)
def k1_store(s, d):
    return orders_store(s, d, True)[1].select("o_orderkey", "outcome", "revision")


@query(
    "k2_store_current",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END AS digest,
       CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS revision
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0
""",
)
def k2_store(s, d):
    return orders_store(s, d, False)[0].current()


@query(
    "k3_store_history",
    """
SELECT o_orderkey, o_orderstatus AS digest, 1 AS revision FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_orderstatus || '!', 2 FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0
""",
)
def k3_store(s, d):
    return orders_store(s, d, False)[0].history()


@query(
    "k4_store_edges",
    """
SELECT c_custkey::VARCHAR AS edge_id, CASE WHEN c_nationkey % 6 = 0 THEN 'MISSING_ENDPOINT' WHEN c_custkey % 3 = 0 THEN 'REVISED' ELSE 'UNCHANGED' END AS outcome,
       CASE WHEN c_nationkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS revision
FROM customer
""",
)
def k4_store(s, d):
    nodes, edges = tree_graph(s, d)
    found = store(s, "nodes", nodes.distinct(), "node_id")
    found.put(nodes.distinct(), "node_id")
    rows = edges.select(F.substring_index("source", "c", -1).alias("edge_id"), "source", "target", F.lit("d").alias("digest"))
    t = store(s, "edges", rows, "edge_id")
    ends = {"source": found, "target": found}
    t.put(rows, "digest", identity=("source", "target"), endpoints=ends)
    again = rows.withColumn("digest", F.when(F.col("edge_id").cast("long") % 3 == 0, "e").otherwise(F.col("digest")))
    return t.put(again, "digest", identity=("source", "target"), endpoints=ends).select("edge_id", "outcome", "revision")


@query("k5_store_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def k5_store(s, d):
    rows = ev(s, d).select("user_id", "event_id", "event_type")
    t = store(s, "profiles", rows, "user_id")
    t.put_latest(rows.where("event_id % 3 = 0"), "event_id")
    t.put_latest(rows.where("event_id % 3 <> 0"), "event_id")
    return t.current().select("user_id", "event_id")
