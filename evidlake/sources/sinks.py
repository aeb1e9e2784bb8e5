"""Idempotent, immutable and versioned writes, as pure functions of what is there and what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_immutable(new: DataFrame, table: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to insert, unchanged rows, and conflicts: the same key with other content, in the table or among the new (K1)."""
    inner = new.groupBy(key).agg(F.countDistinct(digest).alias("versions"))
    rows = new.dropDuplicates([key, digest]).join(inner, key).join(table.select(key, F.col(digest).alias("held")), key, "left")
    clash = (F.col("versions") > 1) | (F.col("held") != F.col(digest))
    drop = lambda df: df.drop("held", "versions")
    return drop(rows.where("held is null and versions = 1")), drop(rows.where((F.col("held") == F.col(digest)) & (F.col("versions") == 1))), drop(rows.where(F.coalesce(clash, F.lit(False))))


def upsert_versioned(new: DataFrame, current: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(current, history rows to add) of rows with a revision (K2, K3): the first is revision 1, equal content none, other content one more.

    New rows carry ``outcome``: INSERTED, REVISED or UNCHANGED.
    """
    held = current.select(key, F.col("revision").alias("held_revision"), F.col(digest).alias("held"))
    rows = new.join(held, key, "left")
    outcome = F.when(F.col("held").isNull(), "INSERTED").when(F.col("held") == F.col(digest), "UNCHANGED").otherwise("REVISED")
    rows = rows.withColumn("outcome", outcome).withColumn("revision", F.coalesce("held_revision", F.lit(0)) + (F.col("outcome") != "UNCHANGED").cast("int")).drop("held", "held_revision")
    kept = current.join(new.select(key), key, "left_anti").withColumn("outcome", F.lit("KEPT"))
    return rows.unionByName(kept.select(*rows.columns)), rows.where("outcome in ('INSERTED', 'REVISED')")


def upsert_edges(new: DataFrame, current: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``upsert_versioned`` on edge_id; edges without an endpoint are rejected (K4)."""
    ok = new
    for end in ("source", "target"):
        ok = ok.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    state, history = upsert_versioned(ok, current, "edge_id", "digest")
    return state, history, new.join(ok.select("edge_id"), "edge_id", "left_anti").withColumn("reject_reason", F.lit("MISSING_ENDPOINT"))


def latest_only(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last profile of each key (K5)."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("rn = 1").drop("rn")


def history_check(current: DataFrame, history: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, revisions, consistent): whether the last revision in history is what is current (K7)."""
    last = history.groupBy(key).agg(F.count("*").alias("revisions"), F.max("revision").alias("last"), F.max_by(digest, "revision").alias("last_digest"))
    rows = current.join(last, key, "full_outer")
    good = F.coalesce((F.col("last") == F.col("revision")) & (F.col("last_digest") == F.col(digest)) & (F.col("revisions") == F.col("last")), F.lit(False))
    return rows.select(key, F.coalesce("revisions", F.lit(0)).alias("revisions"), good.alias("consistent"))


def revision(history: DataFrame, key: str, n: int) -> DataFrame:
    return history.where(F.col("revision") == n)


def assert_safe(df: DataFrame, column: str, forms: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold none of a session's registered secret forms, and rejected rows without that column (K8)."""
    held = F.lit(False)
    for form in forms:
        if form:
            held = held | F.col(column).contains(form)
    held = F.coalesce(held, F.lit(False))
    return df.where(~held), df.where(held).drop(column).withColumn("reject_reason", F.lit("SECRET_PRESENT"))
