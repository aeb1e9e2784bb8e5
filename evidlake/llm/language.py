"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower case; every character that isn't a letter becomes a space and runs of spaces one. All 4-grams of all
training rows are counted per language by Spark. Lower orders follow from the 4-gram types: order n counts the different characters
that precede an n-gram. Counts of all grams and contexts of all orders are kept: Spark writes them, sorted, as Parquet to the shared
folder, whatever store that is on, and the driver holds only where each range of keys lies and each order's discount. An executor takes
the columns it needs once into flat files of its own Spark work folder, which its workers map; a new executor does so again. From
stores other than a file system the Parquet files come to the executors by ``SparkContext.addFile``. What a worker has worked out stays
in a cache of CACHE_BYTES, which changes no result. A text goes to the language of least cross-entropy per character.

Calibration uses all training rows, none scored by a model that learned from it: rows are halved by a checksum of the text, so copies
stay together, and each half is scored by a model of the other half's counts. Counts of all rows and of both halves stand side by side
in one table, so three models cost one sort. By Spark aggregates over these cross-entropies, the
temperature that makes their softmax likeliest gives ``score``; median and spread of each language's own cross-entropy (to CELL nats)
give the value above which a text is ``rejected`` as being in none of the languages. A language with under 5 such rows rejects none.

Defined cases: a null text or one without letters is ``und``, rejected, score 0; without training rows all texts are;
one-letter texts are scored by what they have; very long texts are scored whole; of equal cross-entropies the first language by code
point wins; repeated rows count as often as they occur; other columns aren't read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import mix, shared_dir, staged

ORDER = 4
CACHE_BYTES = 1 << 26
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
CELL = 1e-4
CHUNK_BYTES = 1 << 19
#: Distinct grams that a counting task holds of one language before it hands them on, and rows of a table in one file.
HELD_GRAMS = 1 << 19
PIECE_ROWS = 1 << 20
#: Suffixes of the columns of counts: all rows, and each half.
SIDES = ("", "0", "1")
#: A text is rejected when its cross-entropy is over the median of its language by so many spreads and by so many nats, more
#: for short texts. The nats keep texts that mix known languages.
SPREADS = 10.0
NATS = 1.2
SHORT = 400.0

_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Code point to symbol: letters of the basic plane are themselves, other letters 0xFFFF, the rest a space."""
    if not _TABLE:
        table = np.full(0x110000, 32, dtype=np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = c if c < 0xFFFF else 0xFFFF
        _TABLE.append(table)
    return _TABLE[0]


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each begun by a space, and the offsets of the texts."""
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    symbols = _symbols()[points]
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    blank = symbols == 32
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[starts[:-1]] = True  # each text keeps its first space
    kept = np.concatenate(([0], np.cumsum(keep)))
    return symbols[keep], kept[starts]


def grams(symbols: np.ndarray) -> np.ndarray:
    """Code of the 4-gram that ends at each symbol; the first three are cut short."""
    s = symbols.astype(np.uint64)
    out = s.copy()
    for k in range(1, ORDER):
        out[k:] |= s[:-k] << np.uint64(16 * k)
    return out


def text_chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole lower-case texts of about CHUNK_BYTES bytes; only one run at a time is held as strings."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield first, pc.utf8_lower(column.slice(first, end - first).fill_null("")).to_pylist()
        first, done = end, int(ends[end - 1])


def _inside(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions whose 4-gram lies in one text."""
    good = np.ones(len(symbols), dtype=bool)
    for k in range(ORDER - 1):
        at = offsets[:-1] + k
        good[at[at < len(good)]] = False
    good[offsets[-1] :] = False
    return good


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of the rows (lang, text) that a task reads together, a gram once or more."""

    def merged(parts):
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def out(lang: str, parts) -> Iterator[pa.RecordBatch]:
        codes, n = merged(parts)
        for a in range(0, len(codes), 100_000):
            c = codes[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.view(np.int64)), pa.array(n[a : a + 100_000])], ["lang", "gram", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang in sorted(set(langs)):
                rows_of = pa.array([x == lang for x in langs])
                for _, texts in text_chunks(batch["text"].filter(rows_of)):
                    symbols, offsets = encoded(texts)
                    part = np.unique(grams(symbols)[_inside(symbols, offsets)], return_counts=True)
                    own = found.setdefault(lang, [])
                    own.append(part)
                    if len(own) >= 16:
                        own[:] = [merged(own)]
                        if len(own[0][0]) >= HELD_GRAMS:
                            yield from out(lang, found.pop(lang))
        for lang, parts in found.items():
            yield from out(lang, parts)

    return rows.select("lang", "text").where("lang is not null and text is not null").mapInArrow(read, "lang string, gram long, n long")


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text)."""
    return _counted(rows).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def count_halves(rows: DataFrame) -> DataFrame:
    """(lang, gram, n, n0, n1) over all rows (lang, text): counts of all rows and of each half."""
    counted = _counted(rows.select(F.concat(half().cast("string"), "lang").alias("lang"), "text"))
    sides = [F.sum(F.when(F.substring("lang", 1, 1) == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in SIDES[1:]]
    return counted.groupBy(F.expr("substring(lang, 2)").alias("lang"), "gram").agg(F.sum("n").alias("n"), *sides)


def gram_tables(counts: DataFrame, langs: list[str]) -> DataFrame:
    """(t, key, a, b) of all orders, a and b of each side: t is 8 * language + 2 * (order - 1), and 1 more for contexts. A gram's a is its count, of lower
    orders the number of grams one longer that end in it; a context's a is the sum of the counts of its grams, b their number."""
    ns = [f"n{h}" for h in SIDES]
    level, found = counts.select((F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1).alias("lang"), "gram", *ns), []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            level = staged(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram")).agg(*[F.count_if(F.col(n) > 0).alias(n) for n in ns]))
        t = F.col("lang") * (2 * ORDER) + 2 * (k - 1)
        own = [c for h in SIDES for c in (F.col(f"n{h}").cast("double").alias(f"a{h}"), F.lit(0.0).alias(f"b{h}"))]
        found.append(level.select(t.alias("t"), F.col("gram").alias("key"), *own))
        sums = [c for h in SIDES for c in (F.sum(f"n{h}").cast("double").alias(f"a{h}"), F.count_if(F.col(f"n{h}") > 0).cast("double").alias(f"b{h}"))]
        contexts = level.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("key")).agg(*sums)
        found.append(contexts.select((t + 1).alias("t"), "key", *[f"{c}{h}" for h in SIDES for c in "ab"]))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return staged(out)


def write_tables(tables: DataFrame) -> dict[int, list[tuple]]:
    """Writes the tables to the shared folder, in files sorted by table and key; gives the pieces of each t in order."""
    spark = tables.sparkSession
    folder = f"{shared_dir(spark)}/evidlake-{uuid.uuid4().hex}"
    tables.repartitionByRange(1 + tables.count() // PIECE_ROWS, "t", "key").sortWithinPartitions("t", "key").write.option("compression", "zstd").parquet(folder)
    runs = spark.read.schema(tables.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), "t").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    found: dict[int, list[tuple]] = {}
    ends: dict[str, int] = {}
    for r in runs.orderBy("path", "t").collect():
        at = ends.get(r.path, 0)
        found.setdefault(r.t, []).append((r.first, unquote(r.path), at, r.n))
        ends[r.path] = at + r.n
    whole = unquote(min(ends)).rsplit("/", 1)[0]
    if not whole.startswith("file:"):
        spark.sparkContext.addFile(whole, recursive=True)
    return {t: sorted(p) for t, p in found.items()}


def _mapped(path: str, column: str, dtype: str) -> np.ndarray:
    """One column of a file of the tables, mapped. The executor's first use of it copies it to a flat file, a batch at a time; the rename makes that whole or absent."""
    folder, name = path.split("/")[-2:]
    flat = f"{SparkFiles.getRootDirectory()}/{folder}.{name}.{column}"
    if not os.path.exists(flat):
        part = f"{flat}.{uuid.uuid4().hex}"
        with pq.ParquetFile(re.sub("^file:/+", "/", path) if path.startswith("file:") else SparkFiles.get(f"{folder}/{name}")) as source, open(part, "wb") as out:
            for batch in source.iter_batches(columns=[column]):
                out.write(batch.column(0).to_numpy(zero_copy_only=False).astype(dtype).tobytes())
        os.replace(part, flat)
    return np.memmap(flat, dtype, "r")


class _Table:
    """One side of a table of sorted keys in pieces, each (first key, path, at, length) or (first key, arrays). Only paths are pickled."""

    def __init__(self, pieces: list[tuple], side: str = ""):
        self.pieces, self.side, self.firsts, self.opened = pieces, side, np.array([p[0] for p in pieces], np.int64), {}

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def _arrays(self, i: int) -> tuple[np.ndarray, ...]:
        if i not in self.opened:
            _, *where = self.pieces[i]
            if len(where) == 1:
                self.opened[i] = where[0]
            else:
                path, at, n = where
                self.opened[i] = tuple(np.asarray(_mapped(path, c, d)[at : at + n]) for c, d in (("key", "<i8"), (f"a{self.side}", "<f8"), (f"b{self.side}", "<f8")))
        return self.opened[i]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b of each key, 0 where it isn't in the table."""
        a, b = np.zeros(len(wanted)), np.zeros(len(wanted))
        piece = np.searchsorted(self.firsts, wanted, side="right") - 1
        for i in np.unique(piece[piece >= 0]).tolist():
            own = np.flatnonzero(piece == i)
            keys, x, y = self._arrays(i)
            at = np.minimum(np.searchsorted(keys, wanted[own]), len(keys) - 1)
            seen = keys[at] == wanted[own]
            a[own[seen]], b[own[seen]] = x[at[seen]], y[at[seen]]
        return a, b


def _discount(ones: float, twos: float) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


class LanguageModel:
    """Tables of all languages, in memory or in files; pickled to executors. ``orders`` lists (grams, contexts, discount) of each language from order 1 up."""

    def __init__(self, langs: list[str], codes: list[np.ndarray], counts: list[np.ndarray]):
        orders = []
        for c, n in zip(codes, counts, strict=True):
            order = np.argsort(c)
            c, n, levels = c[order], n[order].astype(np.float64), []
            for k in range(ORDER, 0, -1):
                if k < ORDER:
                    c, n = np.unique(c & np.uint64((1 << (16 * k)) - 1), return_counts=True)
                contexts, at = np.unique(c >> np.uint64(16), return_inverse=True)
                arrays = [(c.view(np.int64), n.astype(float), np.zeros(len(n))), (contexts.view(np.int64), np.bincount(at, weights=n), np.bincount(at).astype(float))]
                of = [_Table([(int(x[0].min()), tuple(y[np.argsort(x[0])] for y in x))] if len(x[0]) else []) for x in arrays]
                levels.append((*of, _discount((n == 1).sum(), (n == 2).sum())))
            orders.append(levels[::-1])
        self._begin(langs, orders)

    @classmethod
    def of_tables(cls, langs: list[str], tables: DataFrame) -> list[LanguageModel]:
        """The models of all rows and of each half, which share one set of files."""
        pieces, models = write_tables(tables), []
        rare = {r.t: r for r in tables.where("t % 2 = 0").groupBy("t").agg(*[F.count_if(F.col(f"a{h}") == c).alias(f"{of}{h}") for h in SIDES for of, c in (("ones", 1), ("twos", 2))], *[F.count_if(F.col(f"a{h}") > 0).alias(f"all{h}") for h in SIDES]).collect()}

        def level(t: int, side: str) -> tuple[_Table, _Table, float]:
            there = rare[t][f"all{side}"] > 0  # a language may be in one half only
            of = [_Table(pieces[x] if there else [], side) for x in (t, t + 1)]
            return *of, _discount(rare[t][f"ones{side}"], rare[t][f"twos{side}"])

        for h in SIDES:
            model = cls.__new__(cls)
            model._begin(langs, [[level(t, h) for t in range(2 * ORDER * j, 2 * ORDER * (j + 1), 2)] for j in range(len(langs))])
            models.append(model)
        return models

    def _begin(self, langs: list[str], orders: list[list[tuple]]) -> None:
        self.langs, self.orders = langs, orders
        self.temperature, self.median, self.spread = 0.1, np.zeros(len(langs)), np.full(len(langs), np.inf)
        self._cache(np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("hashes", "table", "first", "shift")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._cache(np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32))

    def _cache(self, hashes: np.ndarray, table: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.table = hashes[order], table[order]
        bits = max(4, len(hashes).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, dtype=np.int32)
        np.cumsum(np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def _worked_out(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of 4-grams under each language, by interpolation of all orders."""
        out = np.empty((len(codes), len(self.langs)), dtype=np.float32)
        for j, levels in enumerate(self.orders):
            p = np.full(len(codes), 1.0 / 0x10000)
            for k, (grams_of, contexts, discount) in enumerate(levels, 1):
                own = codes & np.uint64((1 << (16 * k)) - 1)
                total, types = contexts.find((own >> np.uint64(16)).view(np.int64))
                n, _ = grams_of.find(own.view(np.int64))
                seen = total > 0
                total = np.where(seen, total, 1.0)
                p = np.where(seen, discount * types / total, 1.0) * p + np.where(n > 0, (n - discount) / total, 0.0)
            out[:, j] = np.log(p)
        return out

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        q = mix(codes)
        bucket = (q >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        last = np.int32(max(0, len(self.hashes) - 1))
        missing = [np.flatnonzero(at >= end)]
        open_ = np.flatnonzero(at < end)
        open_ = open_[self.hashes[at[open_]] != q[open_]]
        while len(open_):
            at[open_] += 1
            out = at[open_] >= end[open_]
            missing.append(open_[out])
            open_ = open_[~out]
            open_ = open_[self.hashes[at[open_]] != q[open_]]
        result = self.table[np.minimum(at, last)] if len(self.hashes) else np.empty((len(codes), len(self.langs)), np.float32)
        lost = np.concatenate(missing)
        if len(lost):
            codes, inverse = np.unique(codes[lost], return_inverse=True)
            found = self._worked_out(codes)
            result[lost] = found[inverse]
            if len(codes) > len(self.hashes) // 50 and (len(codes) + len(self.hashes)) * (4 * len(self.langs) + 24) <= CACHE_BYTES:
                self._cache(np.concatenate([self.hashes, mix(codes)]), np.concatenate([self.table, found]))
        return result

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language, nats per character; and the characters counted (0: no letter)."""
        symbols, offsets = encoded(texts)
        letters = np.concatenate(([0], np.cumsum(symbols != 32)))
        n = offsets[1:] - offsets[:-1]
        has = (letters[offsets[1:]] - letters[offsets[:-1]]) > 0
        codes = grams(symbols)
        for k in range(ORDER - 1):  # the first grams of a text see only spaces before it
            at = offsets[:-1] + k
            at = at[at < offsets[1:]]
            own = codes[at] & np.uint64((1 << (16 * (k + 1))) - 1)
            for j in range(k + 1, ORDER):
                own |= np.uint64(32) << np.uint64(16 * j)
            codes[at] = own
        sums = np.add.reduceat(self.log_probabilities(codes[: offsets[-1]]), offsets[:-1], axis=0, dtype=np.float64) if len(texts) else np.zeros((0, len(self.langs)))
        return -sums / np.maximum(n, 1)[:, None], np.where(has, n, 0)

    def calibrate(self, rows: DataFrame, halves: list[LanguageModel]) -> None:
        """Temperature, medians and spreads from all rows (lang, text), each scored by the half that it isn't in."""
        known, each = rows.sparkSession.sparkContext.broadcast(halves), [f"l{k}" for k in range(len(TEMPERATURES))]

        def scored_by(model: LanguageModel, langs: list[str], column: pa.Array) -> Iterator[pa.RecordBatch]:
            place = {lang: j for j, lang in enumerate(model.langs) if model.orders[j][0][0].pieces}
            for first, texts in text_chunks(column):
                truth = np.array([place.get(lang, -1) for lang in langs[first : first + len(texts)]])
                x, n = model.cross_entropies(texts)
                ok = (n > 0) & (truth >= 0)
                x, truth = x[ok], truth[ok]
                own = x[np.arange(len(x)), truth]
                losses = []
                for t in TEMPERATURES:
                    z = (x.min(axis=1, keepdims=True) - x) / t if len(x) else x
                    losses.append(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth])
                agreed = x.argmin(axis=1) == truth if len(x) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (truth.astype(np.int32), np.rint(own / CELL).astype(np.int64), agreed, *losses)], ["j", "cell", "agreed", *each])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, model in enumerate(known.value):
                    own = batch.filter(pc.not_equal(batch["half"], h))
                    yield from scored_by(model, own["lang"].to_pylist(), own["text"])

        scored = rows.select("lang", "text", half().alias("half")).mapInArrow(read, "j int, cell long, agreed boolean, " + ", ".join(f"{c} double" for c in each))
        cells = staged(scored.groupBy("j", "cell", "agreed").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in each]))
        known.unpersist()
        losses = cells.agg(*[F.sum(c) for c in each]).first()
        if losses[0] is None:
            return
        self.temperature = min(zip(losses, TEMPERATURES, strict=True))[1]
        agreed = cells.where("agreed")
        middle = agreed.groupBy("j").agg(F.percentile("cell", 0.5, F.col("n")).alias("m"), F.sum("n").alias("rows")).where("rows >= 5")
        for r in agreed.join(middle, "j").groupBy("j", "m").agg(F.percentile(F.abs(F.col("cell") - F.col("m")), 0.5, F.col("n")).alias("away")).collect():
            self.median[r.j], self.spread[r.j] = CELL * r.m, max(0.02, 1.4826 * CELL * r.away)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy per character, rejected."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        x, n = self.cross_entropies(texts)
        best = x.argmin(axis=1)
        z = np.exp(-(x - x.min(axis=1, keepdims=True)) / self.temperature)
        own = x[np.arange(len(x)), best]
        limit = self.median[best] + np.maximum(SPREADS * self.spread[best], NATS) * np.sqrt(1 + SHORT / np.maximum(n, 1))
        empty = n == 0
        langs = ["und" if e else self.langs[b] for b, e in zip(best, empty, strict=True)]
        return langs, np.where(empty, 0.0, 1.0 / z.sum(axis=1)), np.where(empty, 0.0, own), empty | (own > limit)


def half() -> Column:
    """0 or 1, by the text."""
    return (F.crc32(F.col("text").cast("binary")) % 2).cast("int")


def train(rows: DataFrame) -> LanguageModel:
    """The model of rows (doc_id, lang, text) whose lang is not null."""
    rows = rows.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = staged(count_halves(rows))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], [], [])
    model, *halves = LanguageModel.of_tables(langs, gram_tables(counts, langs))
    model.calibrate(rows, halves)
    return model


def identify(docs: DataFrame, model: LanguageModel, out: str = "language") -> DataFrame:
    """documents plus struct ``out``: lang_pred, score, cross_entropy, rejected."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(texts: pa.Array) -> pa.Array:
        found: list[list] = [[], [], [], []]
        for _, part in text_chunks(texts):
            for column, values in zip(found, known.value.predict(part), strict=True):
                column.extend(values)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(found, kinds, strict=True)], ["lang_pred", "score", "cross_entropy", "rejected"])

    return docs.withColumn(out, predict(docs["text"]))


def fold(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))
