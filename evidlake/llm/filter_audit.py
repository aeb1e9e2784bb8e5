"""Filter interaction audit: what each filter takes in each order of the filters, and its share over all orders.

Filters are independent of each other's results, so a document is known by the set of filters that it fails (a bit mask). The order of the
filters is a path through the lattice of subsets, from none applied to all applied; the step from subset S by filter f takes the documents
that fail f and nothing in S, whatever the order in which S was reached. So documents are summed by (part, mask) once, and each of the
lattice's edges (S, f) once more. The number of orders that use an edge is the number of ways to reach S (counted forward from the empty
set) times the number of ways from S with f to the full set (counted backward). A filter's Shapley sum is that number times what the edge
takes, over the filter's edges; a given order's steps are read from the same edges.

Spark sums the documents; lattice, edges and orders are tables whose size depends on the number of filters alone (five: 32 states,
80 edges, 120 orders).

Defined cases: a null text is empty, a null source is part ''. Among equal texts those of the least doc_id stay, all of them if that id
repeats; a row of null doc_id counts as no smaller and no larger than any, so it never fails for its text and makes no other fail.
Several labels of one doc_id count if any is set; labels of null doc_id are nobody's. Texts are read whole. An empty table gives no rows; other
columns of any name are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.llm.common import staged

FILTERS = "ABCDE"
MOST_FILTERS = 6
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each subset of n filters, as a bit mask: the orders that reach it from the empty one, and those that leave it for the full one."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for s in range(full + 1):  # a subset is less than what it grows to
        for f in range(n):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in range(full, -1, -1):
        for f in range(n):
            if not s >> f & 1:
                leave[s] += leave[s | 1 << f]
    return reach, leave


def lattice(spark: SparkSession, names: str) -> tuple[DataFrame, DataFrame]:
    """(state, filter, mask, takes, seen, only, passes, weight): what every mask meets on every edge; and (filter_order, step, state, filter)."""
    n = len(names)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, as all their orders are listed")
    reach, leave = path_counts(n)
    edges = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    meets = [
        (s, f, m, m >> f & 1 and not m & s, m >> f & 1 and bool(m & s), m == 1 << f, not m & (s | 1 << f), reach[s] * leave[s | 1 << f])
        for s, f in edges for m in range(1 << n)
    ]
    steps = []
    for order in permutations(range(n)):
        state = 0
        for k, f in enumerate(order):
            steps.append(("".join(names[i] for i in order), k + 1, state, f))
            state |= 1 << f
    columns = "state int, filter int, mask int, takes int, seen int, only int, passes int, weight long"
    return spark.createDataFrame([(*x[:3], *map(int, x[3:])) for x in meets], columns), spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")


def interactions(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """Steps of all orders. masks: part, mask, n, good, toxic (documents that fail exactly the filters of the mask)."""
    meets, steps = lattice(masks.sparkSession, names)
    over = lambda kind, n="n": F.sum(F.col(kind) * F.col(n)).alias(f"{kind}_{n}")
    edges = masks.join(meets, "mask").groupBy("part", "state", "filter", "weight").agg(over("takes"), over("takes", "good"), over("takes", "toxic"), over("seen"), over("only"), over("passes"))
    edges = staged(edges)
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("takes_n") * F.col("weight")).alias("shapley"))
    rows = edges.join(steps, ["state", "filter"]).join(shapley, ["part", "filter"])
    named = {"passes_n": "kept", "takes_n": "removed", "seen_n": "redundant", "only_n": "unique_fails", "takes_good": "good_lost", "takes_toxic": "toxic_lost"}
    return rows.select("part", "filter_order", "step", *[F.col(c).alias(name) for c, name in named.items()], "shapley")


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A few words, B repeated words, C capitals, D markup characters."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def bits(w: Column) -> Column:
        n, kinds, chars, small = (x.cast("long") for x in (F.size(w), F.size(F.array_distinct(w)), F.length(text), F.length(F.translate(text, _UPPER, ""))))
        fails = (n < 200, 100 * kinds < 50 * n, 100 * (chars - small) > 2 * chars, text.rlike(r"[#$%&*|]"))
        return sum((fail.cast("int") * (1 << k) for k, fail in enumerate(fails)), F.lit(0))

    return F.transform(F.array(words), bits)[0]  # the words are split once


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) over whole documents."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_failures(text).alias("own"))
    seen = staged(seen)
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first_id")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = seen.join(first, "digest", "left").join(marks, "doc_id", "left")
    again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * 16
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return rows.withColumn("mask", F.col("own") + again).groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Part, order and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for the five filters."""
    return interactions(failure_masks(docs, labels))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
     x AS (SELECT doc_id, part, text, length(text) AS chars, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
     l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
     b AS (SELECT part, (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b, (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * chars)::INT AS c,
                  regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > first_id, false)::INT AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM x LEFT JOIN l USING (doc_id)),
     m AS (SELECT part, [a, b, c, d, e] AS fails, a + b + c + d + e AS n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY ALL),
     i AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
     o AS (SELECT [i1.f, i2.f, i3.f, i4.f, i5.f] AS fs FROM i i1, i i2, i i3, i i4, i i5 WHERE len(list_distinct([i1.f, i2.f, i3.f, i4.f, i5.f])) = 5),
     s AS (SELECT fs, k.f AS step, fs[k.f] AS f, fs[1:k.f - 1] AS earlier FROM o, i k),
     r AS (SELECT part, list_transform(fs, lambda q: chr(64 + q)) AS fs, step, f, n, good, toxic, n_fails, fails[f] AS own, len(list_filter(earlier, lambda q: fails[q] = 1)) > 0 AS gone FROM m, s),
     t AS (SELECT part, array_to_string(fs, '') AS filter_order, step, f, coalesce(sum(n) FILTER (own = 0 AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own = 1 AND NOT gone), 0) AS removed,
                  coalesce(sum(n) FILTER (own = 1 AND gone), 0) AS redundant, coalesce(sum(n) FILTER (own = 1 AND n_fails = 1), 0) AS unique_fails,
                  coalesce(sum(good) FILTER (own = 1 AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own = 1 AND NOT gone), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM t"""
