"""Benchmark decontamination by spaced-seed hashing.

Texts become words: runs of letters and digits, lower case. A seed hashes the words at the 1s of a fixed mask and ignores
those at its 0s, so a substituted word spares every seed that has a 0 there. Seeds of the benchmark and of the documents are
joined on their hash; each hit proposes a shift between item and document, and the words around the hits are compared under
that shift. An item leaks into a document if, under one shift, some WINDOW aligned words (all words of a shorter item) agree
in at least AGREE per cent; items under LEAST words must agree in full, and with the document's whole text: "Yes" as an item is
held by the document "Yes!", not by every text with that word (``whole_below`` sets the length under which this holds; 0 looks for all items anywhere).

Items of WINDOW words or more have seeds of MASKS at every position: whichever two of WINDOW words are substituted, one of these seeds
keeps clear of them. A shorter item has masks as long as itself: it is cut into parts, and a mask leaves out as many of them as
words may be substituted, in every choice of parts. So no tolerated substitution is missed, at any length. Documents are scanned with the
masks of the lengths that the benchmark has.

The scan of documents keeps only seeds that the benchmark may hold. It asks a bit table of at most 2^23 bits and, where the
benchmark has at most SEEDS_EXACT seeds, their sorted array; both are of bounded size and only thin out what is joined, so a
benchmark beyond the bound gives the same result from a larger join.

Defined cases: null and empty texts hold nothing, and such items are held by nothing; a document is reported once per item with its best
overlap, ties going to the first place; rows are told apart by doc_id and text, so rows of one doc_id, or without one, leak
each for itself (reported under that id, together), and so are items; very long texts are scanned whole; empty tables give an empty result;
further columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import chunks, mix, staged, word_hashes, words

WINDOW = 13
AGREE = 80
LEAST = 8
MASKS = ("11011011", "1110100111", "11001010111")
RADIUS = 2 * WINDOW
SEEDS_EXACT = 1 << 21
BITS_MOST = 1 << 23


def tolerated(n: int) -> int:
    """Words of n aligned ones that may differ."""
    return n - -(-AGREE * n // 100) if n >= LEAST else 0


def short_masks(n: int) -> list[str]:
    """Masks of an item of n words, of which one is clear of any ``tolerated(n)`` places."""
    left_out = tolerated(n)
    parts = np.array_split(np.arange(n), 2 * left_out + 2 - (left_out > 1)) if left_out else []
    masks = []
    for chosen in combinations(parts, left_out):
        mask = np.ones(n, bool)
        for part in chosen:
            mask[part] = False
        masks.append("".join("01"[int(x)] for x in mask))
    return masks


#: (length of the items, 0 for WINDOW words or more; mask)
ALL_MASKS = [(0, m) for m in MASKS] + [(n, m) for n in range(1, WINDOW) for m in short_masks(n)]

_BREAK = np.ones(256, dtype=bool)
_BREAK[128:] = False
for _a, _b in ("09", "AZ", "az"):
    _BREAK[ord(_a) : ord(_b) + 1] = False
_PLACES = [np.flatnonzero([c == "1" for c in m]) for _, m in ALL_MASKS]
_FACTORS = np.random.default_rng(31).integers(1, 1 << 63, (len(ALL_MASKS), 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def masks_of(n: int) -> list[int]:
    """Which of ALL_MASKS an item of n words uses."""
    return [m for m, (length, _) in enumerate(ALL_MASKS) if length == (n if n < WINDOW else 0)]


def token_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of the rows in them)."""
    for first, data, offsets in chunks(pc.utf8_lower(column)):
        w = words(data, offsets, _BREAK, lower=False)
        yield first, word_hashes(w), np.searchsorted(w.row, np.arange(len(offsets)))


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """Seed at every position, across rows too; rows are the caller's to part."""
    n = len(hashes) - len(ALL_MASKS[mask][1]) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(mask + 1), dtype=np.uint64)
    for k in _PLACES[mask]:
        out += hashes[k : k + n] * _FACTORS[mask, k]
    return mix(out)


class SeedFilter:
    """What the scan of documents knows of the benchmark's seeds."""

    def __init__(self, slots: np.ndarray, bits: int, exact: np.ndarray | None):
        self.table = np.zeros(bits, dtype=bool)
        self.table[slots] = True
        self.mask, self.exact = np.uint64(bits - 1), exact

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        if self.exact is not None and len(at):
            place = np.searchsorted(self.exact, hashes[at])
            at = at[self.exact[np.minimum(place, len(self.exact) - 1)] == hashes[at]]
        return at


def _lists(offsets: list[int], values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def keyed(rows: DataFrame, id_: str) -> DataFrame:
    """The id and text of every row, and key, which tells rows of different id or text apart."""
    return rows.select(F.col(id_).cast("long").alias(id_), "text").withColumn("key", F.xxhash64(id_, "text"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): item tells items apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, offsets in token_chunks(batch["text"]):
                own = batch.slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([own["key"], own["item_id"], _lists(offsets.tolist(), hashes)], ["item", "item_id", "words"])

    return keyed(benchmark, "item_id").dropDuplicates(["key"]).mapInArrow(read, "item long, item_id long, words array<long>").where(F.size("words") > 0)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, mask, place, seed)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, masks, places, hashes = [], [], [], [np.zeros(0, np.uint64)]
            for item, own in zip(batch["item"].to_pylist(), batch["words"].to_pylist(), strict=True):
                for m in masks_of(len(own)):
                    found = seeds(np.array(own, dtype=np.int64).view(np.uint64), m)
                    ids += [item] * len(found)
                    masks += [m] * len(found)
                    places += range(len(found))
                    hashes.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(masks, pa.int32()), pa.array(places, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64))], ["item", "mask", "place", "seed"])

    return items.mapInArrow(read, "item long, mask int, place int, seed long")


def _scan(docs: DataFrame, known, masks: list[int], whole_below: int) -> DataFrame:
    """Documents with hits: key, doc_id, hits (seed, place), and the words around them as runs (at, words). Masks of items under ``whole_below`` words hit
    only documents of as many words, so a common short item is no hot seed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value
        hit_type = pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))
        run_type = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.list_(pa.int64()))]))
        for batch in batches:
            for first, hashes, offsets in token_chunks(batch["text"]):
                places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for m in masks:
                    found = seeds(hashes, m)
                    at = keep(found)
                    row = np.searchsorted(offsets, at, side="right")
                    at = at[at + len(ALL_MASKS[m][1]) <= offsets[np.minimum(row, len(offsets) - 1)]]
                    if 0 < ALL_MASKS[m][0] < whole_below:
                        row = np.searchsorted(offsets, at, side="right")
                        at = at[offsets[row] - offsets[row - 1] == ALL_MASKS[m][0]]
                    places.append(at)
                    values.append(found[at])
                place, value = np.concatenate(places), np.concatenate(values)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, value = place[order], value[order]
                rows = np.searchsorted(offsets, place, side="right") - 1
                ids, hits, runs = [], [], []
                for row in np.unique(rows).tolist():
                    a, b = np.searchsorted(rows, [row, row + 1])
                    begin, end = int(offsets[row]), int(offsets[row + 1])
                    own = place[a:b]
                    lo, hi = np.maximum(own - RADIUS, begin), np.minimum(own + RADIUS, end)
                    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                    stops = np.r_[hi[new[1:] - 1], hi[-1]]
                    ids.append(row + first)
                    hits.append([{"seed": int(v), "place": int(p) - begin} for v, p in zip(value[a:b].view(np.int64), own, strict=True)])
                    runs.append([{"at": int(lo[i]) - begin, "words": hashes[lo[i] : e].view(np.int64).tolist()} for i, e in zip(new, stops, strict=True)])
                own = batch.select(["key", "doc_id"]).take(pa.array(ids))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hits, hit_type), pa.array(runs, run_type)], ["key", "doc_id", "hits", "runs"])

    return docs.mapInArrow(read, "key long, doc_id long, hits array<struct<seed:long,place:int>>, runs array<struct<at:int,words:array<long>>>")


def overlap(runs: list[dict], item: np.ndarray, shift: int) -> tuple[int, int]:
    """Words that agree in the overlaps found under ``shift`` (document place less item place), and the first item place; (0, 0) if none."""
    agree, known = np.zeros(len(item), np.int64), np.zeros(len(item), bool)
    for run in runs:
        a, b = max(0, run["at"] - shift), min(len(item), run["at"] + len(run["words"]) - shift)
        if a < b:
            part = np.array(run["words"][a + shift - run["at"] : b + shift - run["at"]], dtype=np.int64)
            agree[a:b] = part == item[a:b]
            known[a:b] = True
    size = min(WINDOW, len(item))
    sums, seen = (np.convolve(x, np.ones(size, np.int64), "valid") for x in (agree, known.astype(np.int64)))
    good = np.flatnonzero((sums >= size - tolerated(size)) & (seen == size))
    if not len(good):
        return 0, 0
    covered = np.zeros(len(item), bool)
    for g in good:
        covered[g : g + size] = True
    return int(agree[covered].sum()), int(good[0])


def _verified(candidates: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [overlap(runs, np.array(item, np.int64), shift) for runs, item, shift in zip(batch["runs"].to_pylist(), batch["words"].to_pylist(), batch["shift"].to_pylist(), strict=True)]
            sizes = pc.list_value_length(batch["words"]).cast(pa.int64())
            arrays = [batch["key"], batch["doc_id"], batch["item_id"], pa.array([n for n, _ in found], pa.int64()), pa.array([s + p for (_, p), s in zip(found, batch["shift"].to_pylist(), strict=True)], pa.int64()), sizes]
            out = pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "item_id", "matched", "at_word", "item_words"])
            yield out.filter(pc.greater(out["matched"], 0))

    return candidates.mapInArrow(read, "key long, doc_id long, item_id long, matched long, at_word long, item_words long")


def _leaks(docs: DataFrame, benchmark: DataFrame, whole_below: int) -> DataFrame:
    """(key, doc_id, item_id, matched, at_word, item_words) of every verified shift."""
    sc = docs.sparkSession.sparkContext
    items = staged(item_words(benchmark))
    parts = staged(item_seeds(items))
    count = parts.count()
    bits = 1 << min(BITS_MOST.bit_length() - 1, max(12, (512 * count).bit_length()))
    slots = parts.select(F.col("seed").bitwiseAND(bits - 1).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    exact = np.sort(parts.select("seed").distinct().toArrow()["seed"].to_numpy().astype(np.int64).view(np.uint64)) if 0 < count <= SEEDS_EXACT else None
    masks = sorted(r.mask for r in parts.select("mask").distinct().collect())
    found = staged(_scan(keyed(docs, "doc_id"), sc.broadcast(SeedFilter(slots.astype(np.int64), bits, exact)), masks, whole_below).dropDuplicates(["key"]))
    hits = found.select("key", F.explode("hits").alias("h")).select("key", F.col("h.seed").alias("seed"), F.col("h.place").alias("at"))
    pairs = hits.join(parts, "seed").select("key", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    return _verified(pairs.join(found.select("key", "doc_id", "runs"), "key").join(items, "item"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, whole_below: int = LEAST) -> DataFrame:
    """(doc_id, item_id, matched, at_word, item_words): every benchmark item that a document holds."""
    best = F.max_by(F.struct("matched", "at_word", "item_words"), F.struct("matched", -F.col("at_word")))
    return _leaks(docs, benchmark, whole_below).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole_below: int = LEAST) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    leaks = staged(_leaks(docs, benchmark, whole_below).select(F.col("key").alias("leak"), F.col("doc_id").alias("leaked")).distinct())
    own = docs["doc_id"].cast("long")
    return docs.join(leaks, (F.xxhash64(own, docs["text"]) == leaks["leak"]) & own.eqNullSafe(leaks["leaked"]), "left_anti")
