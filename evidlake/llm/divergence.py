"""Source divergence audit: how far the word use of each source lies from that of the other sources of its language, and which terms
set it apart.

Frequencies come from single-pass in-memory indexing. A task goes through its documents once and gathers postings (term, lang,
source, occurrences, documents) in a block; when the block fills its memory, it is spilled as a run sorted by term. The runs are a table in
the shared folder. Rows of a hash shard of (term, lang, source) then meet in one task, which merges their runs by a heap and sums
equal keys. A shard's rows are bounded by the number of shards, which grows with the runs; a key has one row a run at most, so no term and
no source is a hot key.

Pair distances are streamed as corrections. A source without a term still gives it its base value (that of a count of 0), so two
sources are V * |base - base| apart before any posting is read; every term that occurs in one of them corrects that sum. Sources
of a language are dealt in tiles of ``TILE``, and a posting goes to its tile's meetings with every tile. A task adds up the corrections of
one meeting over some of the terms, as matrices of at most ``TILE`` columns, and gives one sum for each pair: pairs are never rows before they are
sums.

Shares are 1 + floor(10^9 (count + 5) / (N + 5 V)), in decimals, and distances sums of longs, so results are exact and the same in
every run.

Defined cases: null text, lang or source is read as ''. A group (lang, source) without terms has base values only; a language that keeps no
term has distance 0 between all its sources and no term rows; a language of one source has no pair rows. Ties rank by the item's
UTF-8. Repeated rows count as often as they stand. Long texts are read whole. An empty table gives an empty result; other columns of any
name are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import chunks, staged, words

UNIT, SMOOTH = 1_000_000_000, 5
BLOCK_BYTES = 32 << 20
SHARD_ROWS, FAN, PIECE = 1 << 19, 64, 1 << 13
TILE, TILE_ROWS, TERMS_AT_ONCE = 256, 1 << 18, 512

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_KEY = ["term", "lang", "source"]
_POSTING = pa.schema([("term", pa.binary()), ("lang", pa.string()), ("source", pa.string()), ("cf", pa.int64()), ("df", pa.int64())])
POSTING = "term binary, lang string, source string, cf long, df long"


def _summed(parts: list[pa.Table]) -> pa.Table:
    """Postings with equal keys summed, in order of term, lang and source. Strings are compared once each: rows are ordered by ranks."""
    table = pa.concat_tables(parts).combine_chunks()
    if not len(table):
        return table
    term, lang, source = (table.column(c).chunk(0).dictionary_encode() for c in _KEY)
    order = pc.sort_indices(term.dictionary)
    names = term.dictionary.take(order)
    rank = np.empty(len(names), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    pair, group = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
    named = [(lang.dictionary[x // len(source.dictionary)].as_py().encode(), source.dictionary[x % len(source.dictionary)].as_py().encode()) for x in pair.tolist()]
    by_name = sorted(range(len(named)), key=named.__getitem__)
    place = np.empty(len(named), dtype=np.int64)
    place[by_name] = np.arange(len(named))
    key = rank[term.indices.to_numpy()] * len(named) + place[group]
    rows = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[rows], prepend=-1))
    key = key[rows[first]]
    sums = [pa.array(np.add.reduceat(table.column(c).to_numpy()[rows], first)) for c in ("cf", "df")]
    pair = pair[by_name][key % len(named)]
    of = [coded.dictionary.take(pa.array(at)) for coded, at in ((lang, pair // len(source.dictionary)), (source, pair % len(source.dictionary)))]
    return pa.Table.from_arrays([names.take(pa.array(key // len(named))), *of, *sums], schema=_POSTING)


def _postings(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Postings of whole documents, and one of the empty term for each group, so that groups without terms are known. Columns: text, lang, source."""
    text, lang, source = (batch.column(i) for i in range(3))
    lang_of, source_of = lang.dictionary_encode(), source.dictionary_encode()
    pair = lang_of.indices.to_numpy().astype(np.int64) * len(source_of.dictionary) + source_of.indices.to_numpy()

    def table(group: np.ndarray, term: pa.Array, cf: np.ndarray, df: np.ndarray) -> pa.Table:
        of = lambda coded, at: coded.dictionary.take(pa.array(at))
        columns = [term, of(lang_of, group // len(source_of.dictionary)), of(source_of, group % len(source_of.dictionary)), pa.array(cf), pa.array(df)]
        return pa.Table.from_arrays(columns, schema=_POSTING)

    groups, n = np.unique(pair, return_counts=True)
    yield table(groups, pa.array([b""] * len(groups), pa.binary()), np.zeros(len(groups), np.int64), n)
    for first, data, offsets in chunks(text, 2 << 20):
        w = words(data, offsets, ~_LETTER)
        if not len(w.start):
            continue
        ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)  # the terms' bytes are the letters, one after the other
        found = pa.Array.from_buffers(pa.binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(w.data[_LETTER[w.data]])]).dictionary_encode()
        kinds = len(found.dictionary)
        own, cf = np.unique((first + w.row) * kinds + found.indices.to_numpy(), return_counts=True)  # (document, term)
        key, of, df = np.unique(pair[own // kinds] * kinds + own % kinds, return_inverse=True, return_counts=True)  # (group, term)
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, of, cf)
        yield table(key // kinds, found.dictionary.take(pa.array(key % kinds)), total, df)


def _runs(limit: int):
    """Blocks of postings, each spilled as a run sorted by term when it fills ``limit`` bytes of memory."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, floor = [], 0, 0
        for batch in batches:
            for part in _postings(batch):
                block.append(part)
                held += part.nbytes
                if held - floor > limit // 2:  # what is alike is summed; what is left after that is the block's size
                    block = [_summed(block)]
                    held = floor = block[0].nbytes
                if held > limit:
                    yield from _summed(block).to_batches()
                    block, held, floor = [], 0, 0
        if block:
            yield from _summed(block).to_batches()

    return index


def _falls(batch: pa.RecordBatch) -> list[int]:
    """Places at which a row's key isn't above that of the row before: there another run begins."""
    above, same = None, None
    for name in _KEY:
        a, b = batch.column(name)[:-1], batch.column(name)[1:]
        more = pc.less(a, b) if same is None else pc.and_(same, pc.less(a, b))
        above = more if above is None else pc.or_(above, more)
        same = pc.equal(a, b) if same is None else pc.and_(same, pc.equal(a, b))
    return (np.flatnonzero(~above.to_numpy(zero_copy_only=False)) + 1).tolist()


def _key(piece: pa.RecordBatch, row: int) -> tuple:
    return tuple(piece.column(c)[row].as_py() for c in _KEY)


def _up_to(piece: pa.RecordBatch, key: tuple) -> int:
    return bisect_right(range(len(piece)), key, key=lambda row: _key(piece, row))


def _heap_merge(runs: list[list[pa.RecordBatch]]) -> Iterator[pa.Table]:
    """Sums of equal keys, in blocks of ascending keys. The heap holds the last key of each run's open piece: up to the least of these, every run's rows are at hand."""
    pieces = [(p.slice(i, PIECE) for p in run for i in range(0, len(p), PIECE)) for run in runs]
    opened = [next(p) for p in pieces]
    heap = [(_key(p, len(p) - 1), run) for run, p in enumerate(opened)]
    heapq.heapify(heap)
    while heap:
        bound, taken = heap[0][0], []
        for _, run in heap:
            if n := _up_to(opened[run], bound):
                taken.append(opened[run].slice(0, n))
                opened[run] = opened[run].slice(n)
        yield _summed([pa.Table.from_batches(taken)])
        while heap and heap[0][0] == bound:
            run = heap[0][1]
            if (following := next(pieces[run], None)) is None:
                heapq.heappop(heap)
            else:
                opened[run] = following
                heapq.heapreplace(heap, (_key(following, len(following) - 1), run))


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal keys of the runs in ``batches`` summed by heap merges of ``FAN`` runs; runs are told by where keys fall, so nothing rests on how they arrive."""
    runs, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        cuts = [0, *_falls(batch), len(batch)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            piece = batch.slice(start, end - start)
            if start or last is None or _key(piece, 0) <= last:
                runs.append([])
            runs[-1].append(piece)
            last = _key(piece, len(piece) - 1)
    while len(runs) > FAN:  # as many short runs come from many tasks
        some, runs = runs[:FAN], runs[FAN:]
        runs.append([b for t in _heap_merge(some) for b in t.to_batches()])
    for table in _heap_merge(runs):
        yield from table.to_batches()


def term_frequencies(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(term, lang, source, cf, df): occurrences and documents; a row of the empty term for each (lang, source) that occurs."""
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = staged(read.mapInArrow(_runs(block_bytes), POSTING))
    shards = -(-runs.count() // shard_rows) or 1
    return staged(runs.repartition(shards, *_KEY).mapInArrow(merge_runs, POSTING).withColumn("term", F.col("term").cast("string")))


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(UNIT (count + SMOOTH) / (n + SMOOTH v)) of long columns, exact at any count; 0 where there are no terms."""
    part = f"(cast({UNIT} as decimal(12,0)) * (cast({count} as decimal(19,0)) + {SMOOTH})) div (cast({n} as decimal(19,0)) + {SMOOTH} * cast({v} as decimal(18,0)))"
    return F.expr(f"case when {v} > 0 then 1 + {part} else 0 end")


def _corrections(key: tuple, postings: pa.Table, tiles: pa.Table) -> pa.Table:
    """Sums of pairs of one meeting of two tiles over its terms. tiles: for each side, its sources by number with their base values."""
    lang, a, b = key[0].as_py(), key[1].as_py(), key[2].as_py()
    head = {r["tile"]: r for r in tiles.to_pylist()}
    names, base = ({t: head[t]["sources"] for t in (a, b)}, {t: np.array(head[t]["bases"], dtype=np.int64) for t in (a, b)})
    apart = np.abs(base[a][:, None] - base[b][None, :])
    total = apart * (head[a]["kept"] if key[3].as_py() == 0 else 0)
    if len(postings):
        coded = postings.column("term").combine_chunks().dictionary_encode()
        term, tile = coded.indices.to_numpy(), postings.column("tile").to_numpy()
        place, p = postings.column("place").to_numpy(), postings.column("p").to_numpy()
        order = np.argsort(term, kind="stable")
        term, tile, place, p = term[order], tile[order], place[order], p[order]
        for first in range(0, len(coded.dictionary), TERMS_AT_ONCE):
            some = slice(*np.searchsorted(term, (first, first + TERMS_AT_ONCE)))
            n = min(TERMS_AT_ONCE, len(coded.dictionary) - first)
            value = {}
            for t in {a, b}:
                value[t] = np.repeat(base[t][None, :], n, axis=0)
                own = tile[some] == t
                value[t][term[some][own] - first, place[some][own]] = p[some][own]
            for i in range(len(base[a])):
                total[i] += np.abs(value[a][:, i : i + 1] - value[b]).sum(axis=0)
            total -= n * apart
    s, t = (x.ravel() for x in np.indices(total.shape))
    keep = s < t if a == b else np.ones(len(s), dtype=bool)
    one, two, d = np.array(names[a], dtype=object)[s[keep]], np.array(names[b], dtype=object)[t[keep]], total[s[keep], t[keep]]
    rows = (np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([d, d]))
    return pa.table({"lang": pa.array([lang] * len(rows[0]), pa.string()), "source": pa.array(rows[0], pa.string()), "item": pa.array(rows[1], pa.string()), "value": pa.array(rows[2], pa.int64())})


def pair_distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language. postings: lang, source, term, p; groups: lang, source, kept, base."""
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    placed = staged(groups.withColumn("number", number).select("*", F.floor(F.col("number") / TILE).cast("int").alias("tile"), (F.col("number") % TILE).cast("int").alias("place")))
    members = F.sort_array(F.collect_list(F.struct("place", "source", "base")))  # TILE at most
    tiles = placed.groupBy("lang", "tile").agg(members.alias("m"), F.max("kept").alias("kept"))
    tiles = tiles.select("lang", "tile", F.col("m.source").alias("sources"), F.col("m.base").alias("bases"), "kept")
    at = placed.select("lang", "source", "tile", "place")
    own = postings.select("lang", "source", "term", "p").join(at, ["lang", "source"])
    load = own.groupBy("lang", "tile").agg(F.count("*").alias("n")).groupBy("lang").agg(F.max("n").alias("n"))
    spread = placed.groupBy("lang").agg(F.max("tile").alias("last")).join(load, "lang", "left")
    spread = staged(spread.select("lang", "last", F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) * 2 / TILE_ROWS)).cast("int").alias("parts")))

    def meetings(df: DataFrame) -> DataFrame:
        met = df.join(spread, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        return met.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other"))

    keys = ["lang", "a", "b", "part"]
    left = meetings(own).select("lang", "a", "b", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part"), "term", "tile", "place", "p")
    right = meetings(tiles).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, "tile", "sources", "bases", "kept")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from one table: columns of their own
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_corrections, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_documents: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources (``pair``) and the terms used above the language's share (``term``)."""
    found = term_frequencies(docs)
    counts = found.where("term <> ''")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("all_cf")).where(F.col("df") >= least_documents)
    kept = staged(kept.select("lang", "term", "all_cf"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_cf").alias("all_n"))
    own = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "cf", "all_cf"))
    sums = own.groupBy("lang", "source").agg(F.sum("cf").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = found.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = staged(groups.select("lang", "source", zero("kept"), zero("all_n"), zero("n")).withColumn("base", share("0", "n", "kept")))
    p, q = share("cf", "n", "kept"), share("all_cf", "all_n", "kept")
    postings = staged(own.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(down))
    pairs = pair_distances(postings, groups).withColumn("rank", F.row_number().over(down))
    row = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return row(pairs, "pair").unionByName(row(terms.where(F.col("rank") <= top), "term"))


#: One statement in place of the runs; every occurring group meets every kept term.
ORACLE = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
     w AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
     c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS df FROM w GROUP BY ALL),
     k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30),
     v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
     g AS (SELECT DISTINCT lang, source FROM d),
     m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS all_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
     s AS (SELECT lang, source, sum(n) AS total FROM m GROUP BY ALL),
     p AS (SELECT lang, source, term, m.n, 1 + (1000000000 * (m.n + 5)) // (s.total + 5 * v.v) AS p, 1 + (1000000000 * (m.all_n::HUGEINT + 5)) // (v.n + 5 * v.v) AS q
           FROM m JOIN s USING (lang, source) JOIN v USING (lang)),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
           UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""
