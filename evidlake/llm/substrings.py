"""Removal of repeated long byte strings, on a Burrows-Wheeler transform.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed.

1. Each such string, a window, belongs to one anchor: the K-gram in it of least hash, the leftmost of equals. So equal windows meet at equal
   anchors. Neighbouring windows of one anchor are a site, and the bytes they cover its context.
2. Sites are counted by anchor. A lone anchor has no repeated window. Sites of equal context repeat in full. One copy of every other
   context is taken from its document by a join.
3. A context is cut into pieces by where the anchor lies in a window, WIDTHS[0] places to a class. All windows of a class hold the bytes
   around the anchor that are its core, so pieces with windows in common have equal cores: pieces are grouped by core. A lone piece has no
   repeated window, equal pieces repeat in full, and one copy of each different piece is sent to a block by its core.
4. A block's pieces are sorted as suffixes (prefix doubling) and transformed. Prefix doubling also tells the boundaries between suffixes
   that differ in their first START bytes; from there backward extension goes breadth-first: a boundary between suffixes with l bytes in
   common, extended by the symbols before them, gives boundaries with l + 1, so common prefixes come by increasing value, up to
   ``length - 1``. Boundaries never reached join suffixes with ``length`` or more bytes in common: repeated windows.
5. A core with more than ``hot`` different pieces isn't put into one block: its pieces are cut again into narrower classes, whose
   cores are longer, down to classes of one window, where a core is the window itself. No group outgrows a block, at any size.

Contexts, pieces and cores are told apart by 64-bit hashes, equal contexts and pieces by two of them together.

Defined cases: null is empty; texts under ``length`` bytes keep all and still cover nothing; very long texts are handled whole, in one task
each; repeated rows repeat each other; rows sharing a doc_id are told apart by their text's digest; an empty table gives an empty result;
further columns of documents aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import chunks, prefix_hashes, span_hashes, staged, text_bytes

LENGTH = 400
GRAM = 64
START = 128
BLOCK_BYTES = 2_000_000
HOT = 4_000
WIDTHS = (57, 29, 15, 8, 4, 2, 1)
STEP = 0x5BD1E995


# --- anchors ---------------------------------------------------------------------------------------------------------


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every run of ``width``, from minima within blocks on either side of a block's edge."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    pad = -len(keys) % width
    blocks = np.concatenate([keys, np.full(pad, keys.max(), keys.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def sites(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, place of the anchor from the first window on, anchor and context hash of every site of a chunk."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_hashes(data)
    start = np.arange(len(data) - gram + 1)
    hashes = span_hashes(sums, start, start + gram)
    low = np.uint64(0xFFFFFFFF)
    at = (window_minima((hashes & ~low) | start.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + length <= offsets[row + 1]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.r_[first, len(at)])
    keep = valid[first]
    first, count = first[keep], count[keep]
    anchor = at[first]
    context = span_hashes(sums, first, first + count + length - 1) + (anchor - first).astype(np.uint64) * np.uint64(STEP)
    return row[first], first, count, anchor - first, hashes[anchor], context


def _with_key(docs: DataFrame) -> DataFrame:
    """key tells rows apart that the result must tell apart; equal rows share one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", F.xxhash64("text")))


def all_sites(docs: DataFrame, length: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            for first, data, offsets in chunks(batch["text"]):
                row, start, count, spot, anchor, context = sites(data, offsets, length)
                arrays = [keys[first + row], *(x.astype(np.int32) for x in (start - offsets[row], count, spot)), anchor.view(np.int64), context.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "start", "count", "spot", "anchor", "context"])

    return docs.select("key", "text").mapInArrow(read, "key long, start int, count int, spot int, anchor long, context long")


def context_bytes(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """contexts (anchor, context, key, start, count, spot) with their bytes, each cut from a document of its key."""
    picks = contexts.groupBy("key").agg(F.collect_list(F.struct("anchor", "context", "start", "count", "spot")).alias("sites"))
    texts = docs.groupBy("key").agg(F.first("text").alias("text"))  # equal rows share a key
    names = ["anchor", "context", "count", "spot", "bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            lists = batch["sites"]
            own, site = np.repeat(offsets[:-1], lists.value_lengths().to_numpy()), lists.flatten()
            anchor, context, start, count, spot = (site.field(k) for k in range(5))
            a = own + start.to_numpy()
            body = [data[i:j].tobytes() for i, j in zip(a.tolist(), (a + count.to_numpy() + length - 1).tolist(), strict=True)]
            for k in range(0, len(body), 10_000):
                yield pa.RecordBatch.from_arrays([*(x.slice(k, 10_000) for x in (anchor, context, count, spot)), pa.array(body[k : k + 10_000], pa.binary())], names)

    return texts.join(picks, "key").select("text", "sites").mapInArrow(read, "anchor long, context long, count int, spot int, bytes binary")


# --- pieces ----------------------------------------------------------------------------------------------------------


def pieces(bodies: DataFrame, width: int, length: int, gram: int = GRAM) -> DataFrame:
    """(core, piece, anchor, context, first, count): windows first .. first + count - 1 of a context, of one class each.

    bodies: anchor, context, spot, bytes, and the windows ``first`` and ``count`` in question.
    """
    last = length - gram  # the farthest place of an anchor in a window
    names = ["core", "piece", "anchor", "context", "first", "count"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch["bytes"]):
                n = len(offsets) - 1
                spot, first, count = (batch[c].slice(at, n).to_numpy().astype(np.int64) for c in ("spot", "first", "count"))
                low, high = (spot - first - count + 1) // width, (spot - first) // width
                classes = high - low + 1
                own = np.repeat(np.arange(n), classes)
                k = np.arange(len(own)) - np.repeat(np.cumsum(classes) - classes - low, classes)
                nearest, farthest = k * width, np.minimum(k * width + width - 1, last)
                a = np.maximum(spot[own] - farthest, first[own])
                b = np.minimum(spot[own] - nearest, (first + count)[own] - 1)
                sums, base = prefix_hashes(data), offsets[own]
                core = span_hashes(sums, base + spot[own] - nearest, base + spot[own] - farthest + length) + k.astype(np.uint64) * np.uint64(STEP)
                piece = span_hashes(sums, base + a, base + b + length) + (spot[own] - a).astype(np.uint64) * np.uint64(STEP)
                arrays = [core.view(np.int64), piece.view(np.int64), batch["anchor"].to_numpy()[at + own], batch["context"].to_numpy()[at + own], a.astype(np.int32), (b - a + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    picked = bodies.select("anchor", "context", "spot", "first", "count", "bytes")
    return picked.mapInArrow(read, "core long, piece long, anchor long, context long, first int, count int")


# --- the transform ---------------------------------------------------------------------------------------------------


class Suffixes:
    """Suffix order of several texts, whose ends differ, with the boundaries that ``start`` symbols (a power of 2) already tell."""

    def __init__(self, texts: list[bytes], start: int):
        sizes = np.array([len(t) + 1 for t in texts])
        self.ends = (np.cumsum(sizes) - 1).astype(np.int32)  # places of the terminators
        self.symbols = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.uint16) + 1
        self.symbols[self.ends] = 0
        n = len(self.symbols)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        end = self.ends[self.text]
        padded = np.concatenate([self.symbols, np.zeros(4, np.uint16)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        live = np.ones(n, bool)
        place = np.arange(n, dtype=np.int32)
        left = end - place
        for k in range(4):
            key = (key << np.uint64(9)) | np.where(live, padded[k : k + n], 0)
            live &= left > k
        key = (key << np.uint64(28)) | np.where(live, 0, self.text).astype(np.uint64)  # a text's end is a symbol of its own
        order = np.argsort(key)
        same = np.r_[False, key[order[1:]] == key[order[:-1]]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(same, 0, place))
        open_ = order[same | np.r_[same[1:], False]].astype(np.int32)
        self.early: np.ndarray | None = None
        h = 4
        while len(open_):  # suffixes equal in h symbols don't end within them
            if h >= start and self.early is None:
                self.early = _marked(rank)
            key = (rank[open_].astype(np.uint64) << np.uint64(32)) | rank[open_ + h].astype(np.uint64)
            order = np.argsort(key)
            open_, key = open_[order], key[order]
            group = key >> np.uint64(32)
            at = place[: len(open_)]
            new_group, new = np.r_[True, group[1:] != group[:-1]], np.r_[True, key[1:] != key[:-1]]
            head = np.maximum.accumulate(np.where(new_group, at, 0))
            rank[open_] = group.astype(np.int32) + np.maximum.accumulate(np.where(new, at, 0)) - head
            same = ~new
            open_ = open_[same | np.r_[same[1:], False]]
            h *= 2
        if self.early is None:
            self.early = np.arange(n)
        self.place = rank.astype(np.int64)  # every suffix has a rank of its own by now
        self.order = np.empty(n, np.int64)
        self.order[self.place] = np.arange(n)


def far_boundaries(s: Suffixes, start: int, length: int) -> np.ndarray:
    """For each place in suffix order, whether its suffix and the one before it have ``length`` or more bytes in common.

    ``s.early`` holds the boundaries with under ``start`` symbols in common. The transform at place j is the symbol before the
    suffix there; putting it in front leads to place ahead[j]. A new boundary p parts the suffixes before p from those up to the next
    known boundary. For the first of those with a given symbol before it, whose last equal lies before p, the two extended suffixes
    are neighbours, and have one symbol more in common than p has.
    """
    n = len(s.order)
    known = np.zeros(n + 1, bool)
    known[s.early] = True
    known[n] = True
    has = (s.order > 0) & (s.symbols[s.order - 1] > 0)
    before = np.where(has, s.symbols[s.order - 1], 0)
    ahead = np.where(has, s.place[s.order - 1], -1)
    by_symbol = np.argsort(before.astype(np.uint16), kind="stable")  # a radix sort
    last = np.full(n, -1, np.int64)  # the nearest place above with the same symbol
    last[by_symbol[1:]] = np.where(before[by_symbol[1:]] == before[by_symbol[:-1]], by_symbol[:-1], -1)
    new = s.early
    # The known boundaries in order: most of them, and the latest ones apart.
    stops, recent = np.flatnonzero(known), np.full(1, n)
    for _ in range(start, length):
        if not len(new):
            break
        # The places from each new boundary up to the next known one.
        stop = np.minimum(stops[np.searchsorted(stops, new, side="right")], recent[np.searchsorted(recent, new, side="right")])
        size = stop - new
        begin = np.cumsum(size) - size
        j = np.repeat(new - begin, size) + np.arange(size.sum())
        good = has[j] & (last[j] < np.repeat(new, size))
        q = ahead[j[good]]
        q = q[~known[q]]
        known[q] = True
        q.sort()
        new = q[np.r_[True, q[1:] != q[:-1]][: len(q)]]
        recent = np.sort(np.concatenate([recent, new]), kind="stable")
        if len(recent) * 16 > len(stops):
            stops, recent = np.flatnonzero(known), np.full(1, n)
    return ~known[:n]


def _marked(places: np.ndarray) -> np.ndarray:
    """Distinct places, sorted; all are below their number."""
    flag = np.zeros(len(places), bool)
    flag[places] = True
    return np.flatnonzero(flag)


def repeated_windows(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text, runs [a, b) of window starts that also occur elsewhere among the texts."""
    if not texts:
        return []
    start = 1 << (min(START, length - 1).bit_length() - 1)
    s = Suffixes(texts, start)
    far = far_boundaries(s, start, length)
    hit = s.order[far | np.r_[far[1:], False]]
    flag = np.zeros(len(s.order) + 1, bool)
    flag[hit[hit + length <= s.ends[s.text[hit]]]] = True  # shorter suffixes are no windows
    edges = np.flatnonzero(np.diff(np.r_[False, flag]))
    begin = np.r_[0, s.ends[:-1] + 1]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        t = int(s.text[a])
        out[t].append((a - int(begin[t]), b - int(begin[t])))
    return out


# --- the operator ----------------------------------------------------------------------------------------------------


def _in_blocks(bodies: DataFrame, blocks: int, length: int) -> DataFrame:
    """(anchor, context, a, b): runs of windows of lone pieces that other pieces of their block hold too."""

    def transform(group: pa.Table) -> pa.Table:
        found = repeated_windows(group["bytes"].to_pylist(), length)
        first, lone = group["first"].to_pylist(), group["n"].to_pylist()
        hits = [(k, first[k] + a, first[k] + b) for k, runs in enumerate(found) if lone[k] == 1 for a, b in runs]
        at = pa.array([k for k, *_ in hits], pa.int64())
        return pa.table({"anchor": group["anchor"].take(at), "context": group["context"].take(at), "a": pa.array([a for _, a, _ in hits], pa.int32()), "b": pa.array([b for *_, b in hits], pa.int32())})

    dealt = bodies.withColumn("block", F.pmod(F.xxhash64("core"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(transform, "anchor long, context long, a int, b int")


def shared_windows(bodies: DataFrame, length: int, hot: int) -> DataFrame:
    """(anchor, context, a, b): runs of windows of contexts that other contexts hold too. bodies: anchor, context, count, spot, bytes."""
    open_, found = bodies.withColumn("first", F.lit(0)), None
    for width in WIDTHS:
        cut_ = staged(pieces(open_, width, length))
        each = staged(cut_.groupBy("core", "piece").agg(F.count("*").alias("n"), F.min(F.struct("anchor", "context", "first", "count")).alias("r")))
        several = each.groupBy("core").agg(F.count("*").alias("k")).where("k > 1")
        mixed = staged(each.join(several, "core").select("core", "n", "k", "r.*"))
        whole = cut_.join(each.where("n > 1").select("core", "piece"), ["core", "piece"], "left_semi")
        runs = whole.select("anchor", "context", F.col("first").alias("a"), (F.col("first") + F.col("count")).alias("b"))
        fit = mixed.where(F.col("k") <= hot)
        if size := fit.agg(F.sum(F.col("count") + length)).first()[0]:
            texts = fit.join(bodies.drop("count", "spot"), ["anchor", "context"])
            texts = texts.select("core", "n", "anchor", "context", "first", F.expr(f"substring(bytes, first + 1, count + {length - 1})").alias("bytes"))
            runs = runs.unionByName(_in_blocks(texts, -(-size // BLOCK_BYTES), length))
        runs = staged(runs)
        found = runs if found is None else found.unionByName(runs)
        rest = mixed.where(F.col("k") > hot).select("anchor", "context", "first", "count")
        if rest.isEmpty():
            break
        open_ = bodies.drop("count").join(rest, ["anchor", "context"])
    return found


def repeated_runs(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(key, runs): byte runs [a, b) that repeat, of every keyed document that has any."""
    found = staged(all_sites(docs, length))
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1").select("anchor", "mixed")
    shared = staged(found.join(staged(anchors), "anchor"))
    mixed = shared.where("mixed")
    contexts = staged(mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "count", "spot")).alias("r")))
    bodies = staged(context_bytes(docs, contexts.select("anchor", "context", "r.*"), length))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("count").alias("b")))
    parts = shared.where("not mixed").select("key", "start", whole.alias("runs"))
    # A context has at most as many runs as windows.
    lone = shared_windows(bodies, length, hot).groupBy("anchor", "context").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    runs = contexts.select("anchor", "context", "n", F.col("r.count").alias("count")).join(lone, ["anchor", "context"], "left")
    runs = runs.select("anchor", "context", F.when(F.col("n") > 1, whole).otherwise(F.col("runs")).alias("runs")).where("runs is not null")
    parts = parts.unionByName(mixed.join(staged(runs), ["anchor", "context"]).select("key", "start", "runs"))
    shifted = F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start") + length - 1).alias("b")))
    # Equal rows bring the same runs: a set holds them once.
    return parts.select("key", shifted.alias("runs")).groupBy("key").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def cut(body: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """Bytes left, bytes removed, and maximal removed runs."""
    kept, at, spans, end = [], 0, 0, -1
    for a, b in sorted(runs):
        if a > end:
            spans += 1
            kept.append(body[at:a])
        end = max(end, b)
        at = end
    kept.append(body[at:])
    left = b"".join(kept)
    return left, len(body) - len(left), spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): what is left of every document, as bytes."""
    rows = _with_key(docs)
    runs = staged(repeated_runs(rows, length, hot))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            bodies = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            got = [cut(t, [(r["a"], r["b"]) for r in own]) if own else (t, 0, 0) for t, own in zip(bodies, batch["runs"].to_pylist(), strict=True)]
            arrays = [batch["doc_id"], pa.array([k for k, *_ in got], pa.binary()), pa.array([len(t) for t in bodies], pa.int64()), pa.array([n for _, n, _ in got], pa.int64()), pa.array([s for *_, s in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    shape = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
    return rows.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(read, shape)


def removal_digest(docs: DataFrame) -> DataFrame:
    kept = remove_repeats(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
