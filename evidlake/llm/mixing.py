"""Mixing sources to target weights by Pareto order sampling.

Rows equal in all columns are one unit of m rows. A row is expected ``target / source size`` times in the mix, a unit m times as often. The
whole part of that number is allocated as certain copies, spread evenly over the unit's rows. The rest is the unit's inclusion probability
p for one more copy: with a uniform u fixed by (seed, row), units are ranked by ``(u / (1 - u)) / (p / (1 - p))`` and taken in that order
until the source's words are spent, so the sample has a fixed size in words. At the cut, the next FILL units in order that could bring
the words nearer are gone through once: each that still fits is taken, and at last the next one that overshoots by less than is missing.

The order is cut without sorting a source: ranks are counted in cells of 2^-12, then of 2^-24, and only the rows of the one
cell that holds the cut are ordered. What is joined to documents is one row per source, and one per unit of several rows.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, after the others; repeated rows are
each taken the same number of times, or one more; null doc_ids are ids as any other; ties in rank go by the row's digest; very long texts
are counted whole, and one that would overshoot by more than is missing is passed over; an empty table gives an empty result; a weight
that is null or below 0 counts 0. Columns of documents keep their names, whatever these are; the result is added as one struct column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import staged, word_count

CELL = 4096
FILL = 64
CHUNK = 1000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """Adds ``target`` to rows (source, source_size): shares by weight, stopped at ``cap`` times the source's size.

    Sources by code point, null last, weigh ``weights`` in turn. Stopping some and sharing their excess by weight until
    none is above has one fixed point, a level L with targets ``min(weight * L, cap * size)``; L is read off the sources
    ordered by the level at which each stops. There is one row per source here.
    """
    every = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by_stop = every.orderBy("stop", F.col("source").asc_nulls_last())
    before, onward = (by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing))
    whole = by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
        .withColumn("stop", cap * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("stopped", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("level", F.try_divide(F.col("total") - F.col("stopped"), F.sum("weight").over(onward)))
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("stop"), F.col("level")), ignorenulls=True).over(whole))
    )
    target = F.least(F.col("weight") * F.coalesce("level", F.lit(float("inf"))), cap * F.col("source_size"))
    return rows.select("source", "source_size", F.col("weight").alias("source_weight"), target.cast("double").alias("target"))


def _digest(docs: DataFrame, seed: int) -> Column:
    """A hash of the whole row. Maps have none, so they are hashed as JSON."""
    plain = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else docs[f"`{f.name}`"] for f in docs.schema.fields]
    return F.xxhash64(F.lit(seed), *plain)


def _ranked(units: DataFrame, plan: DataFrame, copies: int) -> DataFrame:
    """Units (of m rows) with their certain copies, inclusion probability and rank in (0, 1)."""
    rows = units.join(plan, units["mix_source"].eqNullSafe(plan["source"]), "left").drop("source")
    expected = F.least(F.try_divide(F.col("mix_weight") * F.col("target"), F.col("weighted_size")), F.lit(float(copies)))
    rows = rows.withColumn("expected", F.coalesce(F.col("m") * expected, F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.floor("expected"))
    u = (F.shiftrightunsigned("unit", 11).cast("double") + 0.5) / float(1 << 53)
    odds = F.try_divide(u / (1 - u), F.col("p") / (1 - F.col("p")))
    rank = F.when((F.col("p") > 0) & F.col("worded"), odds / (1 + odds))
    return rows.withColumn("rank", rank).withColumn("cell", F.floor(F.col("rank") * CELL * CELL))


def _cut(cells: DataFrame, key: str) -> DataFrame:
    """Per source, the first cell in which the words run over what is left, and the words before it."""
    order = Window.partitionBy("mix_source").orderBy(key)
    run = cells.withColumn("upto", F.sum("words").over(order) + F.col("spent"))
    over = run.where(F.col("upto") > F.col("room"))
    first = F.min(F.struct(F.col(key), (F.col("upto") - F.col("words")).alias("spent"), F.col("room")))
    return over.groupBy("mix_source").agg(first.alias("c")).select("mix_source", f"c.{key}", "c.spent", "c.room")


def mix_plan(units: DataFrame, copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """One row per source: its target and where its order is cut. units: unit, doc_id, mix_source, mix_weight, size, worded, m."""
    in_all = F.col("m") * F.col("size")
    sums = units.groupBy(F.col("mix_source").alias("source")).agg(F.sum(in_all).alias("source_size"), F.sum(in_all * F.col("mix_weight")).alias("weighted_size"))
    sums = staged(sums)
    plan = staged(targets(sums.drop("weighted_size"), weights, float(copies), share).join(sums.drop("source_size").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rows = _ranked(units, plan, copies)
    ranked = rows.where("rank is not null")
    certain = rows.groupBy("mix_source", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("words"))
    room = staged(certain.select("mix_source", (F.col("target") - F.col("words")).alias("room")))

    same = lambda a, b: a["mix_source"].eqNullSafe(b["mix_source"])
    cells = ranked.groupBy("mix_source", F.floor(F.col("cell") / CELL).alias("wide")).agg(F.sum("size").alias("words"))
    cells = cells.join(room, same(cells, room)).drop(room["mix_source"]).withColumn("spent", F.lit(0).cast("long"))
    wide = staged(_cut(cells, "wide"))
    inner = ranked.join(wide, same(ranked, wide) & (F.floor(ranked["cell"] / CELL) == wide["wide"])).drop(wide["mix_source"])
    narrow = staged(_cut(inner.groupBy("mix_source", "cell", "spent", "room").agg(F.sum("size").alias("words")), "cell"))
    last = ranked.join(narrow.withColumnRenamed("cell", "cut"), same(ranked, narrow) & (ranked["cell"] == F.col("cut"))).drop(narrow["mix_source"])
    upto = F.sum("size").over(Window.partitionBy("mix_source").orderBy("rank", "unit").rowsBetween(Window.unboundedPreceding, 0)) + F.col("spent")
    edge = last.withColumn("upto", upto).where("upto <= room").groupBy("mix_source").agg(F.max(F.struct("rank", "unit")).alias("edge"))
    n, e = narrow.select("mix_source", F.col("cell").alias("cut")), edge
    cuts = n.join(e, same(n, e), "left").drop(e["mix_source"])
    plan = staged(plan.join(cuts, F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source"))

    # What is left at the cut is filled up in the order of ranks.
    rows = _ranked(units, plan, copies).withColumn("within", _within())
    used = rows.groupBy("mix_source", "target").agg(F.sum((F.col("whole") + F.col("within").cast("int")) * F.col("size")).alias("words"))
    gap = used.select(F.col("mix_source").alias("s"), (F.col("target") - F.col("words")).alias("gap"))
    plan = staged(plan.join(gap, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    rest = _ranked(units, plan, copies).where(F.col("rank").isNotNull() & ~_within() & (F.col("size") < 2 * F.col("gap")))
    nth = F.row_number().over(Window.partitionBy("mix_source").orderBy("rank", "unit"))
    item = F.struct("rank", "unit", "doc_id", F.col("size").cast("double").alias("size"))
    near = rest.withColumn("nth", nth).where(F.col("nth") <= FILL).groupBy("mix_source", "gap").agg(F.sort_array(F.collect_list(item)).alias("near"))
    begin = F.struct(F.col("gap").alias("gap"), F.array_remove(F.slice("near", 1, 1), F.element_at("near", 1)).alias("fill"))
    fits = lambda left, x: x["size"] <= left["gap"]
    take = lambda left, x: F.struct((left["gap"] - x["size"]).alias("gap"), F.concat(left["fill"], F.array(x)).alias("fill"))
    fold = near.withColumn("left", F.aggregate("near", begin, lambda left, x: F.when(fits(left, x), take(left, x)).otherwise(left)))
    over = F.slice(F.filter("near", lambda x: (x["size"] > F.col("left.gap")) & (x["size"] < 2 * F.col("left.gap")) & ~F.array_contains("left.fill", x)), 1, 1)
    fill = staged(fold.select(F.col("mix_source").alias("s"), F.concat("left.fill", over).alias("fillers")))
    return staged(plan.join(fill, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _within() -> Column:
    before = (F.col("cell") < F.col("cut")) | ((F.col("cell") == F.col("cut")) & F.coalesce(F.struct("rank", "unit") <= F.col("edge"), F.lit(False)))
    return F.coalesce(F.col("rank").isNotNull() & (F.col("cut").isNull() | before), F.lit(False))


def _fills() -> Column:
    return F.coalesce(F.exists("fillers", lambda f: (f["unit"] == F.col("unit")) & f["doc_id"].eqNullSafe(F.col("doc_id"))), F.lit(False))


def _times(units: DataFrame, plan: DataFrame, copies: int) -> DataFrame:
    """Units with ``times``, their copies in the mix."""
    return _ranked(units, plan, copies).withColumn("times", (F.col("whole") + (F.col("rank").isNotNull() & (_within() | _fills())).cast("int")).cast("long"))


def _spread(units: DataFrame) -> DataFrame:
    """A row for each of the m rows of a unit, with its ``copies``; none is over another by more than one."""
    rows = units.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK))))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.col("m")) - 1)))
    return rows.withColumn("copies", F.floor(F.col("times") / F.col("m")) + (F.col("nth") < F.col("times") % F.col("m")).cast("int")).drop("chunk", "nth")


def _units(docs: DataFrame, weight: Column | None, seed: int) -> DataFrame:
    worth = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("mix_source"), word_count(F.col("text")).alias("size"), _digest(docs, seed).alias("unit"), worth.alias("mix_weight"))
    alike = base.groupBy("unit", "doc_id", "mix_source").agg(F.first("size").alias("size"), F.first("mix_weight").alias("mix_weight"), F.count("*").alias("m"))
    return staged(alike.withColumn("worded", F.col("size") > 0))


def mix_copies(docs: DataFrame, weight: Column | None = None, seed: int = 17, copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of documents, read once."""
    units = _units(docs, weight, seed)
    rows = _spread(_times(units, mix_plan(units, copies, weights, share), copies))
    return rows.select("doc_id", F.col("mix_source").alias("source"), "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, weight: Column | None = None, seed: int = 17, copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, out: str = "mix") -> DataFrame:
    """documents plus struct ``out``: size, source_size, target, copies (times the row is in the mix), taken (words)."""
    units = _units(docs, weight, seed)
    plan = mix_plan(units, copies, weights, share)
    many = staged(_times(units.where("m > 1"), plan, copies).select(F.col("unit").alias("u"), F.col("doc_id").alias("id"), "m", "times", "size", "source_size", "target"))
    worth = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("mix_source"), _digest(docs, seed).alias("unit"), worth.alias("mix_weight"), docs["text"].rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    same = (F.col("unit") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("id"))
    repeats = not many.isEmpty()
    lone = rows.join(many.select("u", "id"), same, "left_anti") if repeats else rows
    kept = ["d", "size", "source_size", "target", "copies"]
    found = _times(lone.withColumn("m", F.lit(1)), plan, copies).withColumnRenamed("times", "copies").withColumn("size", word_count(F.col("d.text"))).select(*kept)
    if repeats:
        one = rows.join(many.select("u", "id"), same).groupBy("unit", "doc_id").agg(F.first("d").alias("d"))
        found = found.unionByName(_spread(many).join(one, same).select(*kept))
    result = F.struct("size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    # Made before the columns of documents are spread out again, as those may have any names.
    return found.withColumn("mixed", result).select("d.*", F.col("mixed").alias(out))
