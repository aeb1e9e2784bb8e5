import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evidlake.llm import search


def test_top_documents(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 700)
    monkeypatch.setattr(search, "QUERY_BYTES", 2_000)
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(120)]
    texts = [" ".join(vocab[min(119, int(rng.expovariate(0.05)))] for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [texts[50]] * 30 + ["", None, "only", "Only ONLY!", "vé V1"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, terms string").repartition(3)
    for k in (10, 3):
        got = {}
        for r in search.top_documents(df, F.col("doc_id") % 10 == 0, k).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
        bags = [Counter(re.findall(r"[a-z0-9é]+", (t or "").lower())) for t in texts]
        total, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
        seen = Counter(w for b in bags for w in b)
        for q in range(0, len(texts), 10):
            score = {i: sum(search.bm25(b[w], sum(b.values()), mean, seen[w], total) for w in bags[q] if w in b) for i, b in enumerate(bags) if i != q and set(b) & set(bags[q])}
            best = sorted(score, key=lambda i: (-round(score[i], 6), i))[:k]
            own = [d for _, d, _ in sorted(got.get(q, []))]
            assert own == best, (q, [(i, score[i]) for i in best], got.get(q))
    assert search.top_documents(df.limit(0), F.lit(True)).count() == 0


def test_repeated_rows_null_ids_and_long_texts(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(60)]
    query = "alpha beta gamma"
    rows = [(50, query)] * 4 + [(i, f"alpha {' '.join(rng.choices(vocab, k=5))}") for i in range(1, 25)] + [(7, "beta")] * 3
    rows += [(None, "alpha beta gamma"), (None, "alpha"), (100, None), (None, " ".join(rng.choices(vocab, k=70_000)) + " alpha" * 70_000)]
    df = spark.createDataFrame([(*r, 0.5, 3) for r in rows], "doc_id long, text string, score double, rank int").repartition(3)
    got = sorted(search.top_documents(df, F.col("doc_id") % 50 == 0, 10).collect(), key=lambda r: r.rank)
    bags = [Counter((t or "").split()) for _, t in rows]
    total, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    seen = Counter(w for b in bags for w in b)
    score = [(-round(sum(search.bm25(b[w], sum(b.values()), mean, seen[w], total) for w in query.split() if w in b), 6), i is None, i or 0) for (i, _), b in zip(rows, bags, strict=True) if i != 50]
    best = [x for x in sorted(score) if x[0] < 0][:10]
    assert [r.rank for r in got] == list(range(1, 11)) and {r.query_id for r in got} == {50}
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in got] == best


def test_blocks_are_jumped_over(monkeypatch):
    """Texts alike share blocks, and what can't reach the threshold isn't scored."""
    rng = np.random.default_rng(1)
    groups = [rng.integers(1, 1 << 60, 40, dtype=np.uint64) for _ in range(30)]
    terms = [np.unique(rng.choice(g, 30)) for g in groups for _ in range(64)]
    counts = [np.ones(len(t), np.uint32) for t in terms]
    index = search.Index(np.arange(len(terms)), np.zeros(len(terms), bool), np.array([len(t) for t in terms]), terms, counts, 20.0)
    touched = []
    ranges = search._ranges
    monkeypatch.setattr(search, "_ranges", lambda a, b: touched.append(int((b - a).sum())) or ranges(a, b))
    for q in range(0, len(terms), 97):
        touched.clear()
        score, ids, _ = index.top(q, terms[q], np.ones(len(terms[q])), 5, search.NONE)
        every = np.array([np.isin(t, terms[q]).sum() * (search.K1 + 1) / (1 + search.K1 * (1 - search.B + search.B * len(t) / 20.0)) for t in terms])
        every[q] = 0
        order = np.lexsort((np.arange(len(every)), -np.round(every, 6)))[:5]
        assert ids.tolist() == order.tolist() and np.allclose(score, every[order])
        assert sum(touched[1:]) < 0.5 * sum(len(t) for t in terms)


def random_shard(rng, n, common=40):
    """Sizes, sorted words and counts of n documents: each of the first ``common`` words in half of them, others in few."""
    every = rng.permutation(np.arange(1, 4_000, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    terms = [np.unique(np.concatenate([every[:common][rng.random(common) < 0.5], rng.choice(every[common:], rng.integers(0, 12))])) for _ in range(n)]
    counts = [rng.integers(1, 5, len(t)).astype(np.uint32) for t in terms]
    return np.array([int(c.sum()) for c in counts]), terms, counts


def test_postings_of_common_words_are_not_walked(monkeypatch):
    sizes, terms, counts = random_shard(np.random.default_rng(4), 640)
    index = search.Index(np.arange(640), np.zeros(640, bool), sizes, terms, counts, sizes.mean())
    touched = []
    ranges = search._ranges
    monkeypatch.setattr(search, "_ranges", lambda a, b: touched.append(int((b - a).sum())) or ranges(a, b))
    query = max(range(640), key=lambda d: len(terms[d]))
    assert len(index.top(query, terms[query], np.ones(len(terms[query])), 10, search.NONE)[0]) == 10
    held = sum(np.isin(t, terms[query]).sum() for t in terms)
    assert sum(touched) < 0.1 * held


def test_queries_answered_together(monkeypatch):
    """Whatever number a shard answers at a time, over several shards, with null ids, repeated ids and words of no document."""
    rng = np.random.default_rng(9)
    sizes, terms, counts = random_shard(rng, 1_500)
    ids, no_id, mean = rng.integers(0, 1_200, 1_500), rng.random(1_500) < 0.05, sizes.mean()
    ids[no_id] = 0
    weight = dict(zip(np.unique(np.concatenate(terms)).tolist(), rng.random(4_000) * 5 + 0.1, strict=False))
    queries = [(int(ids[d]), terms[d], np.array([weight[t] for t in terms[d].tolist()])) for d in range(0, 1_500, 30)]
    queries += [(-1, np.array([5], np.uint64), np.ones(1)), (-2, np.zeros(0, np.uint64), np.zeros(0))]
    for cells in (1, 1 << 12, 1 << 20):
        monkeypatch.setattr(search, "CELLS", cells)
        best = [search.NONE] * len(queries)
        for a in (0, 20, 900):  # the first shard is smaller than a block
            b = {0: 20, 20: 900, 900: 1_500}[a]
            search.Index(ids[a:b], no_id[a:b], sizes[a:b], terms[a:b], counts[a:b], mean).answer(search.Questions(queries), 10, best)
        for (q, own, idf), (score, found, null) in zip(queries, best, strict=True):
            w = dict(zip(own.tolist(), idf.tolist(), strict=True))
            every = []
            for d in range(1_500):
                s = sum(w[t] * c * (search.K1 + 1) / (c + search.K1 * (1 - search.B + search.B * sizes[d] / mean)) for t, c in zip(terms[d].tolist(), counts[d].tolist(), strict=True) if t in w)
                if s > 0 and (ids[d] != q or no_id[d]):
                    every.append((-round(float(s), 6), bool(no_id[d]), int(ids[d])))
            assert [(-s, bool(x), int(i)) for s, i, x in zip(score, found, null, strict=True)] == sorted(every)[:10]


def test_shards_hold_documents_alike_and_others_queries_pass_them_by(monkeypatch):
    """Two languages in one run: each has its own shard, and lists are only walked for queries that can reach their floor there."""
    rng = np.random.default_rng(12)
    words = np.unique(rng.integers(1, 1 << 60, 6_400, dtype=np.uint64))[:6_000]
    rng.shuffle(words)
    language = rng.integers(0, 2, 1_600)
    own = words.reshape(2, 3_000)
    terms = [np.unique(np.concatenate([own[g][:40][rng.random(40) < 0.5], rng.choice(own[g][40:], rng.integers(5, 60)), own[1 - g][:1]])) for g in language]
    counts = [rng.integers(1, 4, len(t)).astype(np.uint32) for t in terms]
    sizes, ids = np.array([int(c.sum()) for c in counts]), np.arange(1_600)
    groups = search.alike(terms, sizes)
    assert sorted(np.concatenate(groups).tolist()) == ids.tolist() and len(groups) == 2
    assert all(len(set(language[g].tolist())) == 1 for g in groups)
    weight = dict(zip(words.tolist(), (rng.random(6_000) * 5 + 0.1).tolist(), strict=True))
    queries = [(d, terms[d], np.array([weight[t] for t in terms[d].tolist()])) for d in range(0, 1_600, 40)]
    expected = []
    for q, t, w in queries:
        w = dict(zip(t.tolist(), w.tolist(), strict=True))
        impact = lambda d: counts[d] * (search.K1 + 1) / (counts[d] + search.K1 * (1 - search.B + search.B * sizes[d] / sizes.mean()))
        expected.append(sorted((-round(float(sum(w.get(x, 0) * i for x, i in zip(terms[d].tolist(), impact(d).tolist(), strict=True))), 6), d) for d in range(1_600) if d != q)[:10])
    walked = []
    walk = search.Index._walk
    monkeypatch.setattr(search.Index, "_walk", lambda self, term, start, lists: walked.append((len(start) - 1) * len(self.ids)) or walk(self, term, start, lists))
    for floor in (None, np.array([-e[-1][0] for e in expected])):  # floors are the best k-th scores there are: ties stay
        walked.clear()
        best = [search.NONE] * len(queries)
        for g in groups:
            search.Index.read(ids[g], np.zeros(len(g), bool), sizes[g], *search.inverted([terms[i] for i in g], [counts[i] for i in g]), sizes.mean()).answer(search.Questions(queries), 10, best, floor)
        assert [[(-s, d) for s, d in zip(b[0].tolist(), b[1].tolist(), strict=True)] for b in best] == expected
    assert sum(walked) < 0.6 * len(queries) * 1_600


def test_rounds_and_blocks_of_queries(spark, monkeypatch):
    """Whichever runs are searched first, and however many blocks the queries make, answers are those of one round."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    rows = [(i % 260 if i % 17 else None, " ".join(rng.choices(vocab, k=rng.randint(1, 50)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(search, "SHARD_POSTINGS", 900)
    found = []
    for sample, size in ((1, 1 << 20), (3, 1_500), (1 << 40, 1 << 20)):
        monkeypatch.setattr(search, "SAMPLE", sample)
        monkeypatch.setattr(search, "QUERY_BYTES", size)
        found.append(sorted((r.query_id, r.rank, r.doc_id is None, r.doc_id or 0, r.score) for r in search.top_documents(df, F.col("doc_id") % 20 == 0, 5).collect()))
    assert len(found[0]) == 13 * 5 and found[0] == found[1] == found[2]
