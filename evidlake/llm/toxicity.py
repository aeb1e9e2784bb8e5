"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text becomes words (runs of letters and digits, lower case). A word's input has a word part (hashed embedding, and the
lean of its bucket to toxic training documents) and a character part (mean embedding of its hashed
3-grams, and the largest lean among its hashed 3- to 5-grams and, apart, among its beginnings of 4 to 8 bytes). Two gated recurrent networks read
windows of WINDOW words in either direction; attention pools their states into one logit per window. All windows of all texts are scored,
overlapping by WINDOW - STRIDE words; a document has the logit of its highest window, calibrated to a probability.

Training reads at most TRAIN_ROWS labelled rows (all of either class up to half of that, chosen by a hash of doc_id) in
one task. A fifth of them only calibrates. As labels are per document, a toxic document teaches with its strongest windows: by lean
first, in which its own row doesn't count, then by the network itself. Other documents teach with strong and random windows.

Defined cases: a null or empty text has one window of padding and so the lowest evidence; a window shorter than WINDOW
is padded; with training rows of one class only (or none) every score is that class's share (0 with none); a text of any length is scored
whole, and equal windows tie at one logit; repeated rows are scored alike; other columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import CHUNK_BYTES, chunks, mix, prefix_hashes, span_hashes, text_bytes, words
from evidlake.llm.decontamination import _BREAK

TRAIN_ROWS = 4000
WINDOW, STRIDE = 24, 16
HIDDEN, EMBED = 8, 4
WORD_BUCKETS, GRAM_BUCKETS, EMBED_BUCKETS = 1 << 19, 1 << 19, 1 << 13
WINDOWS_OF_ONE = 40
EPOCHS, BATCH, RATE = 4, 512, 0.005
STEPS = 400
DROP, DECAY, SURE = 0.6, 1e-3, 1.5
#: A missed toxic text weighs as much as so many false alarms.
MISS = 2.0
HEADS = (4, 5, 6, 7, 8)
INPUT = 3 + 2 * EMBED


class Vocabulary:
    """The distinct words of a chunk of texts: buckets of each, and which of them stands at each place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = words(data, offsets, _BREAK, lower=False)
        self.bounds = np.searchsorted(w.row, np.arange(len(offsets)))
        sums = prefix_hashes(w.data)
        hashes = span_hashes(sums, w.start, w.end)
        hashes, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        start, end = w.start[first], w.end[first]
        size = end - start
        self.word = (hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int32)
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words that have such grams, buckets, where each word's begin
        self.heads: list[tuple[np.ndarray, np.ndarray]] = []
        for n in (3, 4, 5):
            which = np.flatnonzero(size >= n)
            count = size[which] - n + 1
            begin = np.cumsum(count) - count
            place = np.repeat(start[which] - begin, count) + np.arange(count.sum())
            found = span_hashes(sums, place, place + n)
            self.grams.append((which, (found & np.uint64(GRAM_BUCKETS - 1)).astype(np.int32), begin))

        for n in HEADS:
            which = np.flatnonzero(size >= n)
            found = mix(span_hashes(sums, start[which], start[which] + n) + np.uint64(n))
            self.heads.append((which, (found & np.uint64(GRAM_BUCKETS - 1)).astype(np.int32)))

    def evidence(self, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.word), 3), dtype=np.float32)
        out[:, 0] = word_odds[self.word]
        for which, bucket, begin in self.grams:
            if len(which):
                out[which, 1] = np.maximum(out[which, 1], np.maximum.reduceat(gram_odds[bucket], begin))
        for which, head in self.heads:
            out[which, 2] = np.maximum(out[which, 2], gram_odds[head])
        return out

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word and gram buckets."""
        return np.unique(self.word), np.unique(np.concatenate([*[b for _, b, _ in self.grams], *[h for _, h in self.heads]]))


def windows_of(n: int) -> list[tuple[int, int]]:
    """Windows that cover n words, each STRIDE after the last; at least one."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """How far a bucket's documents lean to one class: its log-odds against the classes' shares, drawn to 0 by SURE standard errors.

    So a bucket seen in two toxic documents alone says little, and one seen in many of both classes nothing.
    """
    share = min(1 - 1e-3, max(1e-3, n_toxic / max(1.0, n_toxic + n_other)))
    toxic, other = np.maximum(toxic, 0.0), np.maximum(other, 0.0)
    value = np.log((toxic + share) / (other + 1 - share)) - np.log(share / (1 - share))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return (np.sign(value) * np.maximum(np.abs(value) - SURE * error, 0.0) / 2).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        put = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"wf": put(INPUT, 3 * HIDDEN), "wb": put(INPUT, 3 * HIDDEN), "uf": put(HIDDEN, 3 * HIDDEN), "ub": put(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32), "a": put(2 * HIDDEN, HIDDEN), "v": put(HIDDEN), "o": put(2 * HIDDEN), "ob": np.zeros(1, np.float32), "word": 0.1 * put(EMBED_BUCKETS, EMBED), "gram": 0.1 * put(EMBED_BUCKETS, EMBED)}

    def inputs(self, evidence: np.ndarray, word: np.ndarray, grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        x = np.zeros((len(word), INPUT), dtype=np.float32)
        x[:, :3] = evidence
        x[:, 3 : 3 + EMBED] = self.p["word"][word % EMBED_BUCKETS]
        which, bucket, begin = grams
        if len(which):
            count = np.diff(np.r_[begin, len(bucket)]).astype(np.float32)
            x[which, 3 + EMBED :] = np.add.reduceat(self.p["gram"][bucket % EMBED_BUCKETS], begin, axis=0) / count[:, None]
        return x

    def _run(self, xp: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list | None) -> list[np.ndarray]:
        """States of one direction. xp: one (batch, gates) array a step; mask: (step, batch, 1)."""
        h, states = np.zeros((xp[0].shape[0], HIDDEN), np.float32), []
        for x, m in zip(xp, mask, strict=True):
            g = h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if m is not None:
                new = np.where(m, new, h)
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * HIDDEN :], m))
            h = new
            states.append(h)
        return states

    def logits(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. table: inputs of words; index: (windows, steps) into it; mask: which steps are words."""
        steps = range(index.shape[1])
        full = mask.all()
        ms = [None if full else mask[:, t, None] for t in steps]
        kf, kb = ([], []) if keep is not None else (None, None)
        pf, pb = table @ self.p["wf"] + self.p["bf"], table @ self.p["wb"] + self.p["bb"]
        hf = self._run([pf[index[:, t]] for t in steps], self.p["uf"], ms, kf)
        hb = self._run([pb[index[:, t]] for t in reversed(steps)], self.p["ub"], ms[::-1], kb)[::-1]
        h = np.concatenate([np.stack(hf, 1), np.stack(hb, 1)], axis=2)
        t = np.tanh(h @ self.p["a"])
        e = t @ self.p["v"]
        e = np.where(mask, e, -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        weight = e / e.sum(axis=1, keepdims=True)
        pooled = (weight[:, :, None] * h).sum(axis=1)
        if keep is not None:
            keep |= {"kf": kf, "kb": kb, "h": h, "t": t, "weight": weight, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["ob"][0]

    def _back(self, dh_all: np.ndarray, kept: list, u: np.ndarray, steps: list[int]) -> tuple[dict[int, np.ndarray], np.ndarray]:
        dh, du, dx = np.zeros((dh_all.shape[0], HIDDEN), np.float32), np.zeros_like(u), {}
        for t, (h, z, r, n, gn, m) in zip(reversed(steps), reversed(kept), strict=True):
            dh = dh + dh_all[:, t]
            live = dh if m is None else dh * m
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            du += h.T @ dg
            dh = live * z + dg @ u.T + (0 if m is None else dh * ~m)
        return dx, du

    def gradients(self, table, index, mask, y, weight_of) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss, gradients of the weights, and that of the table's rows."""
        keep: dict = {}
        logit = self.logits(table, index, mask, keep)
        p = _sigmoid(logit)
        d = ((p - y) * weight_of / len(y)).astype(np.float32)
        h, t, a = keep["h"], keep["t"], keep["weight"]
        g = {"o": keep["pooled"].T @ d, "ob": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["o"]
        dh = a[:, :, None] * dpool[:, None, :]
        da = (h * dpool[:, None, :]).sum(axis=2)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bt,btk->k", de, t)
        dt = de[:, :, None] * self.p["v"] * (1 - t * t)
        g["a"] = np.einsum("bti,btk->ik", h, dt)
        dh = dh + dt @ self.p["a"].T
        steps = list(range(index.shape[1]))
        df, g["uf"] = self._back(dh[:, :, :HIDDEN], keep["kf"], self.p["uf"], steps)
        db, g["ub"] = self._back(dh[:, :, HIDDEN:], keep["kb"], self.p["ub"], steps[::-1])
        dtable = np.zeros_like(table)
        for side, dx in (("f", df), ("b", db)):
            flat, at = np.concatenate([dx[t] for t in steps]), np.concatenate([index[:, t] for t in steps])
            x = table[at]
            g["w" + side], g["b" + side] = x.T @ flat, flat.sum(axis=0)
            np.add.at(dtable, at, flat @ self.p["w" + side].T)
        loss = -np.mean(weight_of * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        return float(loss), g, dtable


class Model:
    """What scoring needs: network, tables of leans and calibration; its size is fixed by the constants above."""

    def __init__(self, network: Network, word_odds: np.ndarray, gram_odds: np.ndarray, slope: float, shift: float):
        self.network, self.word_odds, self.gram_odds, self.slope, self.shift = network, word_odds, gram_odds, slope, shift

    def window_logits(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of a chunk, and the text of each."""
        bounds = vocabulary.bounds
        spans = [(row, bounds[row] + a, bounds[row] + b) for row in range(len(bounds) - 1) for a, b in windows_of(int(bounds[row + 1] - bounds[row]))]
        row, a, b = np.array(spans, dtype=np.int64).T
        table = self.network.inputs(vocabulary.evidence(self.word_odds, self.gram_odds), vocabulary.word, vocabulary.grams[0])
        table = np.concatenate([table, np.zeros((1, INPUT), np.float32)])
        at = np.append(vocabulary.at, len(table) - 1)
        place = a[:, None] + np.arange(WINDOW)
        mask = place < b[:, None]
        out = np.empty(len(row), np.float32)
        index = at[np.where(mask, place, len(at) - 1)]
        # Windows in full need no mask; both kinds are scored in blocks that stay in the cache.
        whole = mask.all(axis=1)
        for pick in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for k in range(0, len(pick), 2048):
                s = pick[k : k + 2048]
                out[s] = self.network.logits(table, index[s], mask[s] | (b[s] == a[s])[:, None])
        return out, row

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, data, offsets in chunks(pc.utf8_lower(column), CHUNK_BYTES // 2):
            logits, row = self.window_logits(Vocabulary(data, offsets))
            out.append(np.maximum.reduceat(logits, np.searchsorted(row, np.arange(len(offsets) - 1))))
        top = np.concatenate(out) if out else np.zeros(0, np.float32)
        return 1 / (1 + np.exp(-np.clip(self.slope * top.astype(np.float64) + self.shift, -40, 40)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.share)


def fit(texts: list[str | None], toxic: np.ndarray, seed: int = 11) -> Model | Constant:
    """Trains on whole texts; everything is drawn from ``seed``, so reruns on the same rows in the same order agree."""
    y = np.asarray(toxic, dtype=bool)
    if not len(y) or y.all() or not y.any():
        return Constant(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    column = pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string()))
    data, ends = text_bytes(column)
    vocabularies = [Vocabulary(data[a:b], np.array([0, b - a])) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]  # one a row, empty texts too
    spare = np.zeros(len(y), bool)
    for kind in (True, False):
        own = rng.permutation(np.flatnonzero(y == kind))
        spare[own[: len(own) // 5]] = True
    counts = {k: (np.zeros(WORD_BUCKETS), np.zeros(GRAM_BUCKETS)) for k in (True, False)}
    buckets = [v.buckets() for v in vocabularies]
    for i in np.flatnonzero(~spare):
        for total, own in zip(counts[bool(y[i])], buckets[i], strict=True):
            total[own] += 1
    n = {k: float((y[~spare] == k).sum()) for k in (True, False)}
    word_odds, gram_odds = (odds(counts[True][k], counts[False][k], n[True], n[False]) for k in (0, 1))

    # One table of all training documents' words, with their own document left out of the leans.
    evidence, grams, strength, spans, base = [], [], [], [], 0
    for i in np.flatnonzero(~spare):
        v, kind = vocabularies[i], bool(y[i])
        less = {k: n[k] - (k == kind) for k in n}
        w, g = buckets[i]
        changed = (word_odds[w].copy(), gram_odds[g].copy())
        for table, own, k in ((word_odds, w, 0), (gram_odds, g, 1)):
            table[own] = odds(counts[True][k][own] - kind, counts[False][k][own] - (not kind), less[True], less[False])
        e = v.evidence(word_odds, gram_odds)
        word_odds[w], gram_odds[g] = changed
        which, bucket, begin = v.grams[0]
        evidence.append(e)
        grams.append((which + base, bucket, begin))
        top = e.max(axis=1)[v.at] if len(v.at) else np.zeros(0)
        own = windows_of(len(v.at))
        strength.append(np.array([top[a:b].max() if b > a else 0.0 for a, b in own]))
        spans.append((base + v.at, own))
        base += len(v.word)
    evidence = np.concatenate([*evidence, np.zeros((1, 3), np.float32)])
    word = np.concatenate([*[vocabularies[i].word for i in np.flatnonzero(~spare)], np.zeros(1, np.int32)])
    skip = np.cumsum([0, *[len(b) for _, b, _ in grams]])
    table_grams = (np.concatenate([w for w, _, _ in grams]), np.concatenate([b for _, b, _ in grams]), np.concatenate([b + s for (_, _, b), s in zip(grams, skip[:-1], strict=True)]))
    net, labels = Network(seed), y[~spare]

    def chosen() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, mask, goal = [], [], []
        for (at, own), s, kind in zip(spans, strength, labels, strict=True):
            if kind:
                pick = np.flatnonzero(s >= s.max() - 0.1 * abs(s.max()))[:4]
            else:
                half = WINDOWS_OF_ONE // 2
                pick = np.unique(np.r_[np.argsort(-s, kind="stable")[:half], rng.integers(0, len(own), half)])
            for k in pick:
                a, b = own[k]
                line = np.full(WINDOW, base)
                line[: b - a] = at[a:b]
                rows.append(line)
                mask.append(np.arange(WINDOW) < max(1, b - a))
                goal.append(kind)
        return np.array(rows), np.array(mask), np.array(goal, dtype=np.float32)

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    first_of = np.searchsorted(table_grams[0], np.arange(base + 2))
    ends = np.r_[table_grams[2], len(table_grams[1])]
    # Few rows are gone over more often, so that every training takes some STEPS steps at least.
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, sum(min(WINDOWS_OF_ONE, len(own)) for _, own in spans))))
    for epoch in range(epochs):
        if epoch == epochs // 2:  # the network's own view of the windows of toxic documents
            for k in np.flatnonzero(labels):
                at, own = spans[k]
                line = np.array([np.r_[at[a:b], np.full(WINDOW - (b - a), base)] for a, b in own])
                live = np.array([np.arange(WINDOW) < max(1, b - a) for a, b in own])
                strength[k] = net.logits(*_compact(net, evidence, word, table_grams, first_of, ends, line)[:2], live).astype(np.float64)
        rows, mask, goal = chosen()
        balance = np.ones(len(goal))
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            s = order[k : k + BATCH]
            table, index, used, own_grams = _compact(net, evidence, word, table_grams, first_of, ends, rows[s])
            drop = rng.random(len(table)) < DROP  # words whose embeddings are left out, so that they aren't learned by heart
            table[drop, 3:] = 0
            _, g, dtable = net.gradients(table, index, mask[s], goal[s], balance[s].astype(np.float32))
            dtable[drop, 3:] = 0
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], word[used] % EMBED_BUCKETS, dtable[:, 3 : 3 + EMBED])
            which, bucket, begin = own_grams
            if len(which):
                count = np.diff(np.r_[begin, len(bucket)])
                np.add.at(g["gram"], bucket % EMBED_BUCKETS, np.repeat(dtable[which, 3 + EMBED :] / count[:, None], count, axis=0))
            for name in ("word", "gram"):
                g[name] += DECAY * net.p[name]
            step += 1
            for name, value in g.items():
                m, v = moments[name]
                m += 0.1 * (value - m)
                v += 0.001 * (value * value - v)
                net.p[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    model = Model(net, word_odds, gram_odds, 1.0, 0.0)
    tops = np.array([model.window_logits(vocabularies[i])[0].max() for i in np.flatnonzero(spare)] or [0.0], dtype=np.float64)
    model.slope, model.shift = calibrated(tops, y[spare].astype(np.float64) if spare.any() else np.zeros(1))
    return model


def _compact(net: Network, evidence, word, grams, first_of, ends, rows):
    """Inputs of just the words that stand in ``rows``: their table, the rows as places in it, which words, and their grams."""
    used, index = np.unique(rows, return_inverse=True)
    index = index.reshape(rows.shape)
    has = first_of[used + 1] > first_of[used]
    slot = first_of[used[has]]
    count = ends[slot + 1] - ends[slot]
    begin = np.cumsum(count) - count
    bucket = grams[1][np.repeat(ends[slot] - begin, count) + np.arange(count.sum())]
    own = (np.flatnonzero(has), bucket, begin)
    return net.inputs(evidence[used], word[used], own), index, used, own


def calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over standardised logits, by damped Newton steps with a pull to slope 2."""
    centre, scale = float(np.median(logit)), float(max(0.1, logit.std()))
    x = np.stack([(logit - centre) / scale, np.ones_like(logit)], axis=1)
    start, weight = np.array([2.0, 0.0]), np.where(y > 0, MISS, 1.0)
    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.5 * (w - start)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    slope = max(0.2, w[0]) / scale
    return float(slope), float(w[1] - slope * centre)


def train(labelled: DataFrame) -> Model | Constant:
    """The model of rows (doc_id, text, toxic): a bounded sample by hash of doc_id, read whole by one task."""
    rows = labelled.where("toxic is not null and doc_id is not null").select("doc_id", "toxic")
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 24))
    sizes = {r.k: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("k")).count().collect()}
    half = TRAIN_ROWS // 2
    bound = {k: int((1 << 24) * min(1.0, max(half, TRAIN_ROWS - sizes.get(not k, 0)) / max(1, sizes.get(k, 0)))) for k in (True, False)}
    picked = rows.where(F.when(F.col("toxic") > 0, place < bound[True]).otherwise(place < bound[False])).select(F.col("doc_id").alias("picked")).distinct()
    # At most about TRAIN_ROWS ids, so they may be broadcast.
    sample = labelled.select("doc_id", "text", "toxic").join(F.broadcast(picked), F.col("doc_id") == F.col("picked"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True)]
        got.sort(key=lambda r: (r[0], r[1] or "", r[2]))
        model = fit([t for _, t, _ in got], np.array([x > 0 for *_, x in got], dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else Constant(0.0)


def score(docs: DataFrame, model: Model | Constant, out: str = "toxicity") -> DataFrame:
    """documents plus double ``out``: the probability that a label would be 1."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        return pd.Series(known.value.scores(pa.Array.from_pandas(texts, type=pa.string()).fill_null("")))

    return docs.withColumn(out, scores(docs["text"]))


def labelled(docs: DataFrame, labels: DataFrame, keep: Column) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents for which ``keep``, over the labels' doc_id, holds."""
    known = labels.where(keep & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(known, "doc_id")
