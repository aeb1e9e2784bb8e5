"""Exact top-k search by BM25, with block-max WAND pruning in inverted indexes of shards.

Queries are whole texts: each distinct word of a query counts once. Every task inverts its documents once, in runs of about SHARD_POSTINGS
postings, and stages them: of each run, documents that share their common words (those of a language) are a shard, whose postings stand in order
of word and document. Statistics (documents, mean length, documents per word) are global, so scores of different shards compare and the k
best of each task hold the k best of all.

A shard that is read has lists of postings for its rare words, and for words that many of its documents hold, a column of impacts, cut into
blocks of BLOCK documents, with the highest impact of each word in each block. Documents stand in order of length, then texts alike next to
each other, so that maxima lie close to what a block's documents have. A query whose words, with their maxima in the shard, don't reach its
threshold passes the shard by. For the others, lists of rare words are added up by document. The pivot of a block is the document that has most
so far: with the maxima of the query's common words, it bounds the block. Blocks whose bound reaches the threshold are opened, a few neighbours
by one product for all queries that open one of them; all others are jumped over. All that is in single precision, with its error
allowed for; documents that can then be among the k best get their score in double precision. Nothing that could enter the top k is left out.

The threshold is the k-th best score so far: of the task, of the pivots of k blocks, and of earlier rounds: one run in SAMPLE answers all queries
first, then EARLY in SAMPLE, then all others. A task gives k rows a query at most, in later rounds only those that reach the threshold.

Queries go to tasks in blocks of about QUERY_BYTES of words, whatever their number and length, so what is broadcast is bounded.

Defined cases: null and empty texts match nothing; documents that share no word with a query aren't returned; ties go to the
smaller doc_id, null last; rows that share the query's doc_id are not its answers; other repeated rows are documents of their own, each with
a rank; query rows of one doc_id are one query of all their words; rows without doc_id ask nothing; very long texts are indexed whole;
an empty table gives an empty result; further columns of documents aren't read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import chunks, staged, word_hashes, words
from evidlake.llm.decontamination import _BREAK

K1, B = 1.2, 0.75
SHARD_POSTINGS = 3_000_000
BLOCK = 64
QUERY_BYTES = 16 << 20
#: A shard answers up to QUERIES at a time, fewer where they would take over CELLS scores.
QUERIES, CELLS = 512, 1 << 21
#: A word is common in a shard if one document in COMMON holds it, and COMMON_LEAST in all: so columns take some 12 * COMMON bytes a posting at most.
COMMON, COMMON_LEAST = 24, 16
#: Sums over lists of rare words are made for WALKED documents of all queries at a time, so that they stay in the processor's cache.
WALKED = 1 << 15
#: Blocks are opened TOGETHER, for the queries that open one of them.
TOGETHER = 12
POSTING = np.dtype([("doc", np.int32), ("score", np.float32)])
NEVER = np.float32(-1e30)
#: Documents of a run are told apart in up to GROUPS groups of GROUP_LEAST at least, by up to GROUP_COLUMNS words that one in GROUP_WORDS of GROUP_SEEN
#: documents holds; centres of a cosine of CLOSE are one. A shard has PIECE documents at most. In a group, lengths are told apart by LENGTHS steps an octave.
GROUPS, GROUP_LEAST, GROUP_SEEN, GROUP_COLUMNS, GROUP_WORDS, CLOSE = 8, 256, 2048, 256, 50, 0.4
PIECE, LENGTHS = 1 << 16, 2
#: Rounds: one in SAMPLE of the tasks' runs is searched first, then EARLY of them, then the others; k-th best scores are thresholds of later rounds.
SAMPLE, EARLY = 64, 8
#: Scores are compared after rounding to DIGITS, so a document this much under the threshold can tie with it.
DIGITS, SLACK = 6, 2e-6


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(doc_ids, words in all, distinct word hashes and how often each occurs) of some of a batch's documents at a time."""
    for first, data, offsets in chunks(pc.utf8_lower(batch["text"])):
        w = words(data, offsets, _BREAK, lower=False)
        hashes = word_hashes(w)
        bounds = np.searchsorted(w.row, np.arange(len(offsets)))
        found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield batch["doc_id"].slice(first, len(found)), np.diff(bounds).astype(np.int64), [t for t, _ in found], [n.astype(np.uint32) for _, n in found]


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, terms): distinct word hashes, packed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, terms, _ in _counted(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([t.tobytes() for t in terms], pa.binary())], ["doc_id", "terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, terms binary")


#: A shard's columns are packed arrays; dealt is a number of the task's documents that it was cut from.
SHARD = "dealt long, n long, words long, ids binary, no_id binary, sizes binary, terms binary, df binary, docs binary, counts binary"


def shards(docs: DataFrame) -> DataFrame:
    """Inverted shards, a row each: the documents of a task in runs of about SHARD_POSTINGS postings, and of a run, each group of documents alike."""

    def rows(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = pa.chunked_array([p[0] for p in parts], pa.int64()).combine_chunks()
        ids, no_id = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null())
        sizes, terms, counts = np.concatenate([p[1] for p in parts]), [t for p in parts for t in p[2]], [n for p in parts for n in p[3]]
        for group in alike(terms, sizes):
            own, df, at, n = inverted([terms[i] for i in group], [counts[i] for i in group])
            at, n = at.astype(_width(len(group))), n.astype(_width(int(n.max(initial=0)) + 1))
            packed = [x.tobytes() for x in (ids[group], no_id[group], sizes[group], own, df, at, n)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, (zlib.crc32(ids.tobytes()), len(group), int(sizes[group].sum()), *packed), strict=True))], schema)

    names = [c.split()[0] for c in SHARD.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in SHARD.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, sizes, terms, counts in _counted(batch):
                at = 0
                while at < len(terms):
                    upto = at
                    while upto < len(terms) and (upto == at or size + len(terms[upto]) <= SHARD_POSTINGS):
                        size += len(terms[upto])
                        upto += 1
                    held.append((ids.slice(at, upto - at), sizes[at:upto], terms[at:upto], counts[at:upto]))
                    at = upto
                    if size >= SHARD_POSTINGS or at < len(terms):
                        yield from rows(held)
                        held, size = [], 0
        if held:
            yield from rows(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, SHARD)


def _width(n: int) -> type:
    """The narrowest type of numbers under n."""
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, df): documents that hold each word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, df = (np.concatenate([*(np.frombuffer(x.as_buffer(), kind) for x in batch[c]), np.zeros(0, kind)]) for c, kind in (("terms", np.uint64), ("df", np.uint32)))
            t, at = np.unique(terms, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(np.bincount(at, df, minlength=len(t)).astype(np.int64))], ["term", "df"])

    return rows.select("terms", "df").mapInArrow(read, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places in the ranges, and the length of each range."""
    size = end - start
    begin = np.cumsum(size) - size
    return np.repeat(start - begin, size) + np.arange(size.sum()), size


class Questions:
    """Queries, as (doc_id, sorted terms, idf), with their words numbered, so that a shard looks each word up once for all of them."""

    def __init__(self, queries: list[tuple[int, np.ndarray, np.ndarray]]):
        self.ids = np.array([q for q, *_ in queries], np.int64)
        size = np.array([len(t) for _, t, _ in queries], np.int64)
        self.query = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.words, first, word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, t, _ in queries)]), return_index=True, return_inverse=True, return_counts=True)
        self.idf = np.concatenate([np.zeros(0), *(w for *_, w in queries)])[first]  # of each word, in whatever query
        # Words of most queries have the first numbers, so that looking them up touches little memory.
        self.number = np.empty(len(n), np.int32)
        self.number[np.argsort(-n, kind="stable")] = np.arange(len(n))
        self.word = self.number[word]


def alike(terms: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """The documents of a shard in groups that share their common words, such as those of a language: centres are the documents furthest from
    all centres so far, moved to the mean of their group, and one if they are close. Whatever the groups, results are the same."""
    of = np.zeros(len(terms), np.int64)
    if len(terms) >= 2 * GROUP_LEAST:
        seen = terms[:: -(-len(terms) // GROUP_SEEN)]
        word, df = np.unique(np.concatenate(seen), return_counts=True)
        word = np.sort(word[np.argsort(-df, kind="stable")[: np.count_nonzero(df * GROUP_WORDS >= len(seen))][:GROUP_COLUMNS]])
        near = np.zeros((len(terms), len(word) + 1), np.float32)
        for a in range(0, len(terms) if len(word) else 0, GROUP_SEEN):
            every = np.concatenate(terms[a : a + GROUP_SEEN])
            at = np.searchsorted(word, every)
            hit = np.flatnonzero(word[np.minimum(at, len(word) - 1)] == every)
            size = [len(t) for t in terms[a : a + GROUP_SEEN]]
            near[np.repeat(np.arange(a, a + len(size)), size)[hit], at[hit]] = 1
        near /= np.maximum(np.sqrt(near.sum(axis=1, keepdims=True)), 1)
        some = near[:: -(-len(terms) // GROUP_SEEN)]
        full = some[some.sum(axis=1) >= np.median(some.sum(axis=1))]  # a text of few words is far from everything
        centres = some.mean(axis=0, keepdims=True)
        for _ in range(GROUPS - 1):
            centres = np.concatenate([centres, full[np.argmin((full @ centres.T).max(axis=1))][None]])
        for _ in range(4):
            of = np.argmax(some @ centres.T, axis=1)
            centres = np.stack([some[of == g].sum(axis=0) for g in range(GROUPS)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        of = np.argmax(near @ centres.T, axis=1)
        close, rank = centres @ centres.T >= CLOSE, np.argsort(-np.bincount(of, minlength=GROUPS), kind="stable")
        joined = np.arange(GROUPS)
        for n, g in enumerate(rank.tolist()):
            joined[g] = next((joined[h] for h in rank[:n].tolist() if close[g, h]), g)
        of = joined[of]
        size = np.bincount(of, minlength=GROUPS)
        of = np.where(size[of] < GROUP_LEAST, np.argmax(size), of)
    # Least hashes are equal for texts alike; among those, texts of a length stand together.
    least = np.array([t[0] if len(t) else 0 for t in terms], np.uint64)
    second = np.array([t[1] if len(t) > 1 else 0 for t in terms], np.uint64)
    order = np.lexsort((second, least, (np.log2(sizes + 1) * LENGTHS).astype(np.int64), of))
    groups = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []
    return [part for group in groups for part in np.array_split(group, -(-len(group) // PIECE))]


def inverted(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(words, how many documents hold each, documents, counts) of documents in the order given: postings by word and document, words of most
    documents first, so that what queries touch most lies together."""
    every = np.concatenate([*terms, np.zeros(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
    df = np.diff(np.append(new, len(every)))
    most = np.argsort(-df, kind="stable")
    words_, first, df = every[new[most]], new[most], df[most]
    del every, new
    order = order[_ranges(first, first + df)[0]]
    doc = np.repeat(np.arange(len(terms), dtype=np.uint32), [len(t) for t in terms])
    return words_, df.astype(np.uint32), doc[order], np.concatenate([*counts, np.zeros(0, np.uint32)]).astype(np.uint32)[order]


class Index:
    """Postings of one shard. Impacts leave out the word's own weight, which the query brings."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, sizes: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], mean: float):
        order = np.concatenate([*alike(terms, sizes), np.zeros(0, np.int64)]).astype(np.int64)
        self._build(ids[order], no_id[order], sizes[order], *inverted([terms[i] for i in order], [counts[i] for i in order]), mean)

    @classmethod
    def read(cls, *columns) -> Index:
        index = cls.__new__(cls)
        index._build(*columns)
        return index

    def _build(self, ids: np.ndarray, no_id: np.ndarray, sizes: np.ndarray, terms: np.ndarray, df: np.ndarray, docs: np.ndarray, counts: np.ndarray, mean: float) -> None:
        self.ids, self.no_id, self.terms = ids, no_id, terms
        self.by_id = np.flatnonzero(~no_id)[np.argsort(ids[~no_id], kind="stable")]
        df, tf = df.astype(np.int64), counts.astype(np.float64)
        impacts = (K1 * (1 - B + B * sizes / max(mean, 1e-9)))[docs]
        impacts += tf
        np.divide(tf * (K1 + 1), impacts, out=impacts)
        del tf
        self.most = np.maximum.reduceat(impacts, np.cumsum(df) - df) if len(df) else np.zeros(0)
        # The words of each document, and what they give it.
        term = np.repeat(np.arange(len(df), dtype=np.int32), df)
        order = np.argsort(docs.astype(np.uint16) if len(ids) <= 1 << 16 else docs, kind="stable")
        self.of_doc = np.append(0, np.cumsum(np.bincount(docs, minlength=len(ids))))
        self.held, self.gives = term[order], impacts[order]
        # Words of many documents have a column of impacts each, block by block, and a maximum in each block.
        common = (df >= COMMON_LEAST) & (df * COMMON >= len(ids))
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.blocks = -(-len(ids) // BLOCK)
        self.dense = np.zeros((self.blocks * BLOCK, int(common.sum())), np.float32)
        rare = np.repeat(~common, df)
        self.dense[docs[~rare], self.column[term[~rare]]] = impacts[~rare]
        self.highest = self.dense.reshape(self.blocks, BLOCK, self.dense.shape[1]).max(axis=1)
        self.df = np.where(common, 0, df)
        self.of_term = np.append(0, np.cumsum(self.df))
        self.docs, self.impacts = docs[rare].astype(np.int32), impacts[rare].astype(np.float32)

    def top(self, query: int, terms: np.ndarray, idf: np.ndarray, k: int, best: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """The k best of ``best`` and of this shard, as (rounded score, doc_id, whether it is null). terms are sorted."""
        found = [best]
        self.answer(Questions([(query, terms, idf)]), k, found)
        return found[0]

    def answer(self, asked: Questions, k: int, best: list[tuple[np.ndarray, ...]], floor: np.ndarray | None = None) -> None:
        """``top`` for all queries: best[j] holds what is found for query j. floor: scores that k documents elsewhere reach."""
        if not len(self.terms) or not len(asked.words):
            return
        at = np.searchsorted(asked.words, self.terms)
        at[at == len(asked.words)] = 0
        here = np.flatnonzero(asked.words[at] == self.terms)
        idf, number = np.zeros(len(self.terms)), np.full(len(asked.words), -1, np.int32)
        idf[here] = asked.idf[at[here]]
        number[asked.number[at[here]]] = here
        term = number[asked.word]
        found = np.flatnonzero(term >= 0)
        query, term = asked.query[found], term[found]
        threshold = np.array([b[0][k - 1] if len(b[0]) >= k else 0.0 for b in best])
        threshold = np.maximum(threshold if floor is None else np.maximum(threshold, floor), SLACK) - SLACK
        # Queries whose words, with their maxima in the shard, don't reach the threshold pass it by.
        bound = np.bincount(query, (idf * self.most)[term], minlength=len(best))
        live = np.flatnonzero((bound > 0) & (bound * (1 + 1e-9) >= threshold))
        # Those that have most here come first, so that queries that open the same blocks are answered together.
        live = live[np.argsort(-bound[live] / (threshold[live] + 1), kind="stable")]
        size = np.bincount(query, minlength=len(best))
        start = np.cumsum(size) - size
        # Lists of rare words: a document and what the word gives it, in 8 bytes.
        postings = np.empty(len(self.docs), POSTING)
        postings["doc"], postings["score"] = self.docs, self.impacts * np.repeat(idf.astype(np.float32), self.df)
        lists = pa.Array.from_buffers(pa.large_binary(), len(self.df), [None, pa.py_buffer(self.of_term * POSTING.itemsize), pa.py_buffer(postings)])
        step = max(1, min(QUERIES, CELLS // max(1, self.blocks * BLOCK, self.dense.shape[1])))
        weigh = np.zeros(len(self.terms))
        for first in range(0, len(live), step):
            part = live[first : first + step]
            place, own = _ranges(start[part], start[part] + size[part])
            self._answer(asked.ids[part], part, term[place], np.append(0, np.cumsum(own)), idf, weigh, lists, threshold[part], k, best)

    def _walk(self, term: np.ndarray, start: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For queries whose terms begin at start, the sums of their rare words by block and document, and the most in each block."""
        width = self.blocks * BLOCK
        sums, pivots = np.empty((len(start) - 1, self.blocks, BLOCK), np.float32), np.empty((len(start) - 1, self.blocks), np.float32)
        length = self.df[term]
        ends = np.append(0, np.cumsum(length))[start].tolist()
        step = max(1, WALKED // width)
        for a in range(0, len(sums), step):
            b = min(a + step, len(sums))
            own = term[start[a] : start[b]]
            data = lists.take(pa.array(own[length[start[a] : start[b]] > 0])).buffers()[2]
            found = np.frombuffer(data, POSTING, ends[b] - ends[a]) if data else np.zeros(0, POSTING)
            doc = found["doc"].astype(np.int64)
            for j in range(1, b - a):
                doc[ends[a + j] - ends[a] : ends[a + j + 1] - ends[a]] += j * width
            sums[a:b] = np.bincount(doc, found["score"], minlength=(b - a) * width).reshape(b - a, self.blocks, BLOCK)
            pivots[a:b] = sums[a:b].max(axis=2)
        return sums, pivots

    def _answer(self, ids: np.ndarray, part: np.ndarray, term: np.ndarray, start: np.ndarray, idf: np.ndarray, weigh: np.ndarray, lists: pa.Array, threshold: np.ndarray, k: int, best: list[tuple[np.ndarray, ...]]) -> None:
        score, pivots = self._walk(term, start, lists)
        column = self.column[term]
        weights = np.zeros((len(part), self.dense.shape[1]), np.float32)
        common = np.flatnonzero(column >= 0)
        weights[np.repeat(np.arange(len(part)), np.diff(start))[common], column[common]] = idf[term[common]]
        # Single precision is off by less than this share of a score: products and sums of numbers that are never negative.
        off = (self.dense.shape[1] + 16) * 2.0**-23
        by_id = self.ids[self.by_id]
        place, own = _ranges(np.searchsorted(by_id, ids), np.searchsorted(by_id, ids, side="right"))
        own, place = np.repeat(np.arange(len(ids)), own), self.by_id[place]
        score[own, place // BLOCK, place % BLOCK] = NEVER
        pivots[own, place // BLOCK] = score[own, place // BLOCK].max(axis=1)

        # A block's pivot is the document of most by its rare words; with the maxima of the others it bounds the block.
        def reached(pivots: np.ndarray) -> np.ndarray:
            """What k documents of as many blocks reach, or else the threshold."""
            if self.blocks < k:
                return threshold
            return np.maximum(threshold, -np.partition(-pivots, k - 1, axis=1)[:, k - 1] * (1 - off) - SLACK)

        bound = (np.maximum(pivots, 0) + weights @ self.highest.T) * (1 + off)
        opened = (bound > 0) & (bound >= reached(pivots)[:, None])
        for a in range(0, self.blocks, TOGETHER):
            asking = np.flatnonzero(opened[:, a : a + TOGETHER].any(axis=1))
            if len(asking):
                inside = score[asking, a : a + TOGETHER]
                inside += (weights[asking] @ self.dense[a * BLOCK : (a + TOGETHER) * BLOCK].T).reshape(inside.shape)
                score[asking, a : a + TOGETHER] = inside
                pivots[asking, a : a + TOGETHER] = inside.max(axis=2)
        least = np.maximum(reached(pivots) * (1 - off), 0).astype(np.float32)
        row, block = np.nonzero((pivots > 0) & (pivots >= least[:, None]))
        inside = score[row, block]
        which, doc = np.nonzero((inside > 0) & (inside >= least[row, None]))
        row, doc, about = row[which], block[which] * BLOCK + doc, inside[which, doc]
        # Of each query, the k best by these scores and those as good within their error are worked out in double precision.
        order = np.lexsort((-about, row))
        row, doc, about = row[order], doc[order], about[order].astype(np.float64)
        edges = np.searchsorted(row, np.arange(len(part) + 1)).tolist()
        for j in np.unique(row).tolist():
            a, b = edges[j], edges[j + 1]
            if b - a > k:
                b = a + int(np.searchsorted(-about[a:b], -(about[a + k - 1] * (1 - 2 * off) - 2 * SLACK), side="right"))
            score_, found = self._exact(np.sort(doc[a:b]), term[start[j] : start[j + 1]], idf, weigh)
            keep = (score_ > 0) & (score_ >= threshold[j])
            if keep.any():
                found, q = found[keep], part[j]
                best[q] = _best(k, *(np.concatenate(x) for x in zip(best[q], (np.round(score_[keep], DIGITS), self.ids[found], self.no_id[found]), strict=True)))

    def _exact(self, docs: np.ndarray, term: np.ndarray, idf: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, docs) of documents, all of which share a word with the query."""
        weigh[term] = idf[term]
        score = np.array([weigh[self.held[a:b]] @ self.gives[a:b] for a, b in zip(self.of_doc[docs].tolist(), self.of_doc[docs + 1].tolist(), strict=True)])
        weigh[term] = 0
        return score, docs


NONE = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))


def _best(k: int, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> tuple[np.ndarray, ...]:
    if len(score) > 4 * k:  # ties with the k-th stay for the sort
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids, no_id = score[keep], ids[keep], no_id[keep]
    order = np.lexsort((ids, no_id, -score))[:k]
    return score[order], ids[order], no_id[order]


def weighted_queries(queries: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(query_id, terms, idf): the words of each query in order and their weights, packed."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.frombuffer(t.as_buffer(), np.int64) for t in batch["terms"]]
            ids = np.repeat(batch["doc_id"].to_numpy(), [len(t) for t in every])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([*every, np.zeros(0, np.int64)]))], ["query_id", "term"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, idf = [], []
            for words_ in batch["words"]:
                t, w = (words_.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(t.view(np.uint64))
                terms.append(t[order].tobytes())
                idf.append(w[order].tobytes())
            yield pa.RecordBatch.from_arrays([batch["query_id"], pa.array(terms, pa.binary()), pa.array(idf, pa.binary())], ["query_id", "terms", "idf"])

    rows = queries.where("doc_id is not null").select("doc_id", "terms").mapInArrow(spread, "query_id long, term long").distinct()
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    listed = rows.join(counts, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("words"))
    return listed.mapInArrow(pack, "query_id long, terms binary, idf binary")


def _answers(rows: DataFrame, asked, floor, mean: float, k: int) -> DataFrame:
    """(query_id, doc_id, score): for each query, the k best of each task's documents, of those that reach its floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, least = asked.value, floor.value
        best = [NONE] * len(questions.ids)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, no_id, sizes, terms, df = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in (("ids", np.int64), ("no_id", bool), ("sizes", np.int64), ("terms", np.uint64), ("df", np.uint32)))
                total = max(1, int(df.sum()))
                packed = (np.frombuffer(x, f"u{max(1, x.size // total)}") for x in (batch["docs"][i].as_buffer(), batch["counts"][i].as_buffer()))
                Index.read(ids, no_id, sizes, terms, df, *packed, mean).answer(questions, k, best, least)
        query = np.repeat(questions.ids, [len(b[0]) for b in best])
        if len(query):
            score, ids, no_id = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=no_id), pa.array(score)], ["query_id", "doc_id", "score"])

    return rows.mapInArrow(search, "query_id long, doc_id long, score double")


def top_documents(docs: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best other documents of every row for which ``is_query`` holds."""
    sc = docs.sparkSession.sparkContext
    rows = staged(shards(docs))
    total, words_in_all = rows.agg(F.sum("n"), F.sum("words")).first()
    mean = (words_in_all or 0) / max(1, total or 0)
    weighted = staged(weighted_queries(document_words(docs.where(is_query)), term_counts(rows), total or 0))
    blocks = max(1, -(-(weighted.agg(F.sum(F.octet_length("terms"))).first()[0] or 0) // QUERY_BYTES))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = None
    for block in range(blocks):
        part = weighted.where(F.pmod(F.xxhash64(F.lit(7), "query_id"), F.lit(blocks)) == block).toArrow()
        questions = Questions([(q, np.frombuffer(t, np.uint64), np.frombuffer(w, np.float64)) for q, t, w in zip(*(part[c].to_pylist() for c in ("query_id", "terms", "idf")), strict=True)])
        del part
        asked, floor, answers = sc.broadcast(questions), np.zeros(len(questions.ids)), None
        dealt = F.pmod("dealt", F.lit(SAMPLE))
        for runs in (dealt == 0, (dealt > 0) & (dealt < EARLY), dealt >= max(1, EARLY)):
            if answers is not None:
                reached = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score").toArrow()
                at = np.argsort(questions.ids)
                floor[at[np.searchsorted(questions.ids[at], reached["query_id"].to_numpy())]] = reached["score"].to_numpy()
            least = sc.broadcast(floor)
            best = staged(_answers(rows.where(runs), asked, least, mean, k))
            least.unpersist()
            answers = best if answers is None else answers.unionByName(best)
        found = answers if found is None else found.unionByName(answers)
        asked.unpersist()
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def bm25(tf: int, size: int, mean: float, df: int, total: int) -> float:
    """The score of one word, for reference."""
    return math.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
