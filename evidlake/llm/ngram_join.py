"""Similarity join of documents on Jaccard similarity of word n-grams, as a grouped prefix join.

A document's set is its distinct shingles of ``size`` words (the whole sequence as one if it has fewer), words being lower-case
A-Z runs between white space. Two documents link when ``100 * shared >= percent * united``, decided on 64-bit shingle hashes.

1. ``shingle_counts``: how many sets hold each shingle, counted exactly in 2^32 cells. Each task packs sorted cells into short
   byte strings by cell range and ranges are merged apart, so no shuffle carries a row a shingle.
2. Every set is ordered from its rarest shingle to its commonest; its prefix is as long as two linked sets must share one
   shingle in. Equal sets become one class. Classes of equal prefix and size become one group.
3. Groups that share a prefix shingle are paired if their sizes and places in the order allow a link; surviving pairs are expanded to classes,
   thinned by parity bits of the sets, which bound how many shingles differ, and verified on their full sets.
4. A shingle whose list has over SHORT_LIST members isn't paired all with all. Its members are compared with a leader
   in ROUNDS rounds and joined into components; then only pairs of members from different components, at least one of them outside the
   list's largest one, are compared. Pairs left out are already connected, so the components are exact.
5. ``links`` counts all links. Linked sets lie in one component, so in components with members of long lists all members are compared
   with all, once a pair, in blocks of some BLOCK members dealt by hash; elsewhere step 3 has compared every pair.

Only sets of documents that take part in a pair are made again and joined; nothing of all documents reaches the driver but
shingle cells counted often, of which there are at most HOT_CELLS.

Defined cases: null, empty and blank texts have the empty set, link with nothing and form their own component; equal texts, and texts
that differ in case or white space only, are one class; repeated rows give a row each; classes are the nodes, and different texts under one
doc_id tie their classes, so that what links with one of them is reached from all (ties are no links and don't count in ``links``); rows of null
doc_id are left alone, each its own component (null); texts of any length are read whole; an empty table gives an empty result; only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import chunks, mix, partitions, shingle_sets, staged
from evidlake.llm.components import components

HOT_CELLS = 1 << 21
LEAST_HOT = 4
SHORT_LIST = 12
ROUNDS = 3
FLUSH = 2_000_000
BITS = 1024
BLOCK = 256
BLOCK_BYTES = 1 << 24
COLUMNS = 1 << 14
BROADCAST_IDS = 500_000


def least_shared(n1: Column, n2: Column, percent: int) -> Column:
    """The fewest shared shingles with which sets of these sizes link."""
    return F.ceil(percent * (n1 + n2) / F.lit(100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- how common shingles are -----------------------------------------------------------------------------------------


def pack(cells: np.ndarray, counts: np.ndarray, base: int) -> bytes:
    """Sorted cells as 16-bit gaps with 16-bit counts; a gap of 65535 with count 0 is a step on the way."""
    gap = np.diff(cells.astype(np.int64), prepend=base)
    steps = gap // 65535
    width = steps + 1
    out = np.zeros((2, int(width.sum())), dtype=np.uint16)
    last = np.cumsum(width) - 1
    out[0] = 65535
    out[0, last] = gap % 65535
    out[1, last] = counts
    return out.tobytes()


def unpack(data: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    gap, count = np.frombuffer(data, dtype=np.uint16).reshape(2, -1)
    cells = base + np.cumsum(gap.astype(np.int64))
    return cells[count > 0], count[count > 0].astype(np.int64)


def shingle_counts(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells (top 32 bits of the hash) counted most, sorted, and their counts: all from a bound that at most HOT_CELLS reach."""
    ranges = 1 << min(16, max(4, (4 * partitions(docs)).bit_length()))
    shift = 32 - (ranges.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bounds = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.int64) << shift)
            rows = [(r, pack(cells[a:b], n[a:b], r << shift)) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["range", "data"])

        total = 0
        for batch in batches:
            for _, data, offsets in chunks(batch["text"]):
                for s in shingle_sets(data, offsets, size):
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    total += len(s)
                    if total >= FLUSH or len(held) >= 65_000:
                        yield flush()
                        total = 0
        if held:
            yield flush()

    packed = staged(docs.select("text").mapInArrow(count, "range int, data binary"))

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        base = key[0].as_py() << shift
        parts = [unpack(d, base) for d in group["data"].to_pylist()]
        cells, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([k for _, k in parts])).astype(np.int64)
        return pa.table({"cell": cells[n >= LEAST_HOT], "n": n[n >= LEAST_HOT]})

    hot = staged(packed.groupBy("range").applyInArrow(merge, "cell long, n long"))
    # The least count that at most HOT_CELLS cells reach, off a histogram.
    bins = sorted(hot.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r.bin)
    bound, held = 1 << 62, 0
    for r in bins:
        held += r.k
        if held > HOT_CELLS:
            break
        bound = r.n
    got = hot.where(F.col("n") >= bound).toArrow()
    cells, n = got["cell"].to_numpy().astype(np.uint32), got["n"].to_numpy().astype(np.int64)
    order = np.argsort(cells)
    return cells[order], n[order]


# --- sets, prefixes, classes -----------------------------------------------------------------------------------------


def ordered(shingles: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted set from its rarest shingle to its commonest; ties by hash."""
    if not len(cells):
        return shingles
    own = (shingles >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
    hot = cells[at] == own
    if not hot.any():
        return shingles
    common = shingles[hot]
    return np.concatenate([shingles[~hot], common[np.lexsort((common, counts[at[hot]]))]])


def signatures(docs: DataFrame, size: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, f1, f2, bits, prefix) for every row: set size, digest of the set, parity bits of its shingles, prefix in order."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = known.value
        for batch in batches:
            for first, data, offsets in chunks(batch["text"]):
                n, f1, f2, bits, ends, prefixes = [], [], [], [], [0], [np.zeros(0, np.uint64)]
                for s in shingle_sets(data, offsets, size):
                    p = ordered(s, cells, counts)[: prefix_size(len(s), percent)] if len(s) else s
                    n.append(len(s))
                    f1.append(digest(s))
                    f2.append(int(mix(s ^ np.uint64(0x5BF0A8B1457695A3)).sum(dtype=np.uint64).view(np.int64)))
                    bits.append(np.packbits((np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64))
                    prefixes.append(p)
                    ends.append(ends[-1] + len(p))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))
                ids = batch["doc_id"].slice(first, len(n))
                parity = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (BITS // 64), pa.int32()), pa.array(np.concatenate(bits)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), parity, lists], ["doc_id", "n", "f1", "f2", "bits", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, n long, f1 long, f2 long, bits array<long>, prefix array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles): packed sorted sets of the classes in ids (id, of, f1), each from a document of doc_id ``of`` and that digest.

    Up to BROADCAST_IDS ids are broadcast, so texts stay where they are; more are joined by a shuffle.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = docs.select(F.col("doc_id").cast("long").alias("of"), "text").join(ids, "of")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch["f1"].to_numpy()
            for first, data, offsets in chunks(batch["text"]):
                sets = list(shingle_sets(data, offsets, size))
                own = [k for k, s in enumerate(sets) if digest(s) == wanted[first + k]]
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array([first + k for k in own], pa.int64())), pa.array([sets[k].tobytes() for k in own], pa.binary())], ["id", "shingles"])

    return picked.select("id", "text", "f1").mapInArrow(read, "id long, shingles binary")


def digest(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=np.uint64).view(np.int64))


# --- pairs -----------------------------------------------------------------------------------------------------------


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _places_allow(percent: int) -> Column:
    """Whether sets that share this shingle first can share enough: columns n1, p1, n2, p2."""
    return F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) >= least_shared(F.col("n1"), F.col("n2"), percent)


def _side(lists: DataFrame, k: int) -> DataFrame:
    return lists.select("key", F.col("id").alias(f"id{k}"), F.col("n").alias(f"n{k}"), F.col("place").alias(f"p{k}"))


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All admissible pairs (a < b) within lists of at most SHORT_LIST members."""
    short = lists.where(F.col("members") <= SHORT_LIST)
    pairs = _side(short, 1).join(_side(short, 2), "key").where((F.col("id1") < F.col("id2")) & _sizes_allow("n1", "n2", percent) & _places_allow(percent))
    return pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()


def _bits_allow(n1: str, n2: str, bits1: str, bits2: str, percent: int) -> Column:
    """Whether parity bits allow a link: bits that differ are at most the shingles that only one set has."""
    differ = F.aggregate(F.zip_with(bits1, bits2, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    return differ <= F.col(n1) + F.col(n2) - 2 * least_shared(F.col(n1), F.col(n2), percent)


def leader_pairs(long: DataFrame, percent: int, turn: int) -> DataFrame:
    """Members of long lists with the leader of their list in this round."""
    lead = long.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "bits")).alias("l"))
    lead = lead.select("key", F.col("l.id").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.bits").alias("lead_bits"))
    pairs = long.join(lead, "key").where((F.col("id") != F.col("lead")) & _sizes_allow("n", "lead_n", percent) & _bits_allow("n", "lead_n", "bits", "lead_bits", percent))
    return pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def apart_pairs(long: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Admissible pairs of long lists whose members are not connected yet."""
    long = long.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    parts = long.groupBy("key", "label").agg(F.count("*").alias("k"))
    main = parts.groupBy("key").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("m.label").alias("main"))
    open_ = staged(long.join(main, "key").select("key", "id", "n", "place", "bits", "label", (F.col("label") == F.col("main")).alias("in_main")))
    side = lambda df, k: df.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("id", "n", "bits", "label")], F.col("place").alias(f"p{k}"))
    pairs = side(open_.where("not in_main"), 1).join(side(open_, 2), "key").where((F.col("label1") != F.col("label2")) & _sizes_allow("n1", "n2", percent) & _places_allow(percent) & _bits_allow("n1", "n2", "bits1", "bits2", percent))
    return pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def alike(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity bits allow a link."""
    side = lambda k: members.select(F.col("id").alias("ab"[k]), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    return pairs.join(side(0), "a").join(side(1), "b").where(_bits_allow("n0", "n1", "bits0", "bits1", percent)).select("a", "b")


def members_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                shared = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0
                keep.append(shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    # A repeated row can give its set twice.
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(read, "a long, b long").distinct()


def degrees(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, links) of nodes (node, label): with how many others of its label each one links, all compared with all in blocks."""
    sized = nodes.join(sets.select(F.col("id").alias("node"), "shingles").dropDuplicates(["node"]), "node")
    blocks = sized.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("int").alias("k"))
    dealt = sized.join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "shingles")

    def count(key: tuple, group: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        own, node = group["own"].to_numpy(), group["node"].to_numpy()
        sets_ = [np.frombuffer(b, np.uint64) for b in group["shingles"].to_pylist()]
        sides = [np.flatnonzero(own == block) for block in (low, high)]
        if not all(map(len, sides)):
            return pa.table({"node": node[:0], "links": np.zeros(0, np.int64)})
        sizes = [np.array([len(sets_[i]) for i in side]) for side in sides]
        values = [np.concatenate([sets_[i] for i in side]) for side in sides]
        rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
        both = np.intersect1d(*map(np.unique, values)) if low < high else np.unique(values[0])
        at = [np.minimum(np.searchsorted(both, v), max(0, len(both) - 1)) for v in values]
        held = [both[p] == v if len(both) else np.zeros(len(v), bool) for p, v in zip(at, values, strict=True)]
        places = [(r[h], p[h]) for r, p, h in zip(rows, at, held, strict=True)]
        shared = np.zeros((len(sides[0]), len(sides[1])), np.int64)
        for first in range(0, len(both), COLUMNS):
            parts = []
            for n, (r, p) in zip(sizes, places, strict=True):
                inside = (p >= first) & (p < first + COLUMNS)
                parts.append(np.zeros((len(n), min(COLUMNS, len(both) - first)), np.float32))
                parts[-1][r[inside], p[inside] - first] = 1
            shared += np.rint(parts[0] @ parts[1].T).astype(np.int64)
        linked = (shared > 0) & (100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared))
        if low == high:
            np.fill_diagonal(linked, False)
            return pa.table({"node": node[sides[0]], "links": linked.sum(axis=1)})
        return pa.table({"node": np.concatenate([node[side] for side in sides]), "links": np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])})

    return dealt.groupBy("label", "low", "high").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of groups as pairs of their classes. members: gid, id."""
    return pairs.join(members.select(F.col("gid").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("gid").alias("b"), F.col("id").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, links): every row with its set's size, the least doc_id it is connected to, and the number of
    classes that its class links with (0 if it was connected as a copy only). ``links`` is left out where it isn't asked for."""
    hot = shingle_counts(docs, size)
    rows = staged(signatures(docs, size, percent, hot))
    filled = rows.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("of"))
    several = filled.count() > filled.select("doc_id").distinct().count()
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id() if several else F.col("of")))
    ties = None
    if several:  # rows of one doc_id: their classes have numbers of their own
        held = staged(filled.join(classes, ["n", "f1", "f2"]).select("doc_id", "id").distinct())
        hubs = held.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a < most").select("doc_id", "a")
        ties = staged(held.join(hubs, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct())
        one = filled.join(classes, ["n", "f1", "f2"]).where("doc_id = of").dropDuplicates(["id"])
    else:
        copies = staged(filled.join(classes, ["n", "f1", "f2"]).where("doc_id <> id").select("doc_id"))
        one = filled.join(copies, "doc_id", "left_anti").withColumnRenamed("doc_id", "id")
    one = one.select("id", "n", "f1", "bits", "prefix", F.xxhash64("prefix").alias("h1"), F.xxhash64(F.lit(1), "prefix").alias("h2"))
    grouped = one.groupBy("n", "h1", "h2").agg(F.min("id").alias("gid"), F.count("*").alias("k"))
    members = staged(one.select("id", "n", "bits", "h1", "h2").join(grouped, ["n", "h1", "h2"]).select("gid", "id", "n", "bits", "k"))
    others = staged(members.where("gid <> id").select("id"))
    groups = staged(one.join(others, "id", "left_anti").select("id", "n", F.posexplode("prefix").alias("place", "key")))
    lists = staged(groups.join(groups.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key"))
    inner = staged(members.where("k > 1").select(F.col("gid").alias("key"), "id", "n", F.lit(0).alias("place"), F.col("k").alias("members")))

    # Long lists hold classes, since a group's classes need not be connected.
    owned = members.select("gid", "id", "bits")
    long = lists.where(F.col("members") > SHORT_LIST).withColumnRenamed("id", "gid").join(owned, "gid").select("key", "id", "n", "place", "bits")
    long = staged(long.unionByName(inner.where(F.col("members") > SHORT_LIST).join(owned.drop("gid"), "id").select(F.xxhash64("key", F.lit("group")).alias("key"), "id", "n", "place", "bits")))
    # Leaders don't depend on what was found before, so all rounds are verified at once.
    pairs = alike(_expanded(short_pairs(lists, percent), members).unionByName(short_pairs(inner, percent)).distinct(), members, percent)
    for turn in range(ROUNDS):
        pairs = pairs.unionByName(leader_pairs(long, percent, turn))
    pairs = staged(pairs.distinct())
    taken = lambda ids: staged(sets_of(docs, staged(classes.join(ids, "id", "left_semi").select("id", "of", "f1")), size))
    sets = taken(members_of(pairs))
    links = staged(verified(pairs, sets, percent))
    labels = staged(components(links))
    more = staged(apart_pairs(long, labels, percent).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        sets = sets.unionByName(taken(members_of(more).join(sets.select("id"), "id", "left_anti")))
        found = staged(verified(more, sets, percent))
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = staged(components(links))
    # Ties come last, so that every link has been looked for.
    named = labels if ties is None else staged(components(links.unionByName(ties)))
    classes = classes.select("n", "f1", "f2", "of", F.col("id").alias("node")).join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if several:  # a component's name is its least doc_id
        classes = staged(classes)
        classes = classes.join(classes.groupBy("label").agg(F.min("of").alias("least")), "label").withColumn("label", F.col("least")).drop("least")
    if count_links:
        partly = labels.join(long.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("label").distinct()
        dense = staged(labels.join(partly, "label", "left_semi").select("node", "label"))
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        degree = ends.join(dense, "node", "left_anti").groupBy("node").agg(F.count("*").alias("links")).unionByName(degrees(dense, sets, percent))
        classes = classes.join(degree, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    classes = staged(classes.drop("node", "of"))
    whole = rows.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"), *([F.coalesce("links", F.lit(0)).alias("links")] if count_links else []))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents without near copies: of each component of texts the row of the least doc_id, with all columns.

    Texts are told apart as rows, not by doc_id: where ids repeat or are null, rows get numbers of their own, and a text never goes
    because another one has its doc_id. Null ids come last; of rows that tie any one stays. All rows without words stay.
    """
    n, named, kinds = docs.select(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n == named == kinds:
        copies = staged(similar_documents(docs, size, percent, count_links=False).where("doc_id <> component_id").select(F.col("doc_id").alias("copy")))
        return docs.join(copies, docs["doc_id"].cast("long") == copies["copy"], "left_anti")
    rows = staged(docs.withColumn("row_of_near_copies", F.monotonically_increasing_id()))
    found = similar_documents(rows.select(F.col("row_of_near_copies").alias("doc_id"), "text"), size, percent, count_links=False)
    ids = rows.select(F.col("row_of_near_copies").alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    kept = staged(found.join(ids, F.col("doc_id") == F.col("row")).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("kept_row")))
    return rows.join(kept, rows["row_of_near_copies"] == kept["kept_row"], "left_semi").drop("row_of_near_copies")
