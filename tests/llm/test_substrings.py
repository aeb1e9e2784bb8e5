"""Removal of repeated strings against brute force."""

import os
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from evidlake.llm import substrings


def brute_removed(texts, length):
    where = {}
    for t, body in enumerate(texts):
        for i in range(len(body) - length + 1):
            where.setdefault(body[i : i + length], []).append((t, i))
    cover = [np.zeros(len(b), bool) for b in texts]
    for found in where.values():
        if len(found) > 1:
            for t, i in found:
                cover[t][i : i + length] = True
    return cover


def repeating(rng):
    noise = lambda k: "".join(rng.choices("abcdefgh é", k=k))
    passage, other = noise(700), noise(450)
    out = [noise(300) + passage + noise(200), passage[100:600] + noise(300), noise(50) + passage[:420] + noise(700) + other, other + other, "z " * 900, noise(399), "", None, passage[:399] + "!" + passage[400:]]
    near = noise(1500)
    for _ in range(12):
        c = list(near)
        c[rng.randrange(len(c))] = "#"
        out.append("".join(c))
    return out + [noise(2000)] * 3 + [noise(rng.randint(0, 900)) for _ in range(8)]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeats(spark, hot):
    texts = repeating(random.Random(3))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    bodies = [(t or "").encode() for t in texts]
    cover = brute_removed(bodies, 400)
    for r in substrings.remove_repeats(df, hot=hot).collect():
        c = cover[r.doc_id]
        assert bytes(r.kept) == bytes(np.frombuffer(bodies[r.doc_id], np.uint8)[~c]), r.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(c), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) > 0).sum()))
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_transform_alone():
    rng = random.Random(8)
    for _ in range(20):
        texts = ["".join(rng.choices("ab", k=rng.randint(60, 400))).encode() for _ in range(4)]
        texts += [texts[0][10:300] + b"x", b"\0" * 120, b""]
        length = 70
        cover = brute_removed(texts, length)
        for body, runs, c in zip(texts, substrings.repeated_windows(texts, length), cover, strict=True):
            assert (as_cover(runs, len(body), length) == c).all()


def as_cover(runs, n, length):
    got = np.zeros(n, bool)
    for a, b in runs:
        got[a : b + length - 1] = True
    return got


def test_near_copies_in_the_transform():
    for seed in range(60):
        rng = random.Random(seed)
        base = rng.randbytes(736)
        texts = []
        for _ in range(12):
            c = bytearray(base)
            for _ in range(rng.randint(1, 2)):
                c[rng.randrange(736)] = rng.randrange(256)
            n = rng.randint(560, 616)
            a = rng.randrange(736 - n)
            texts.append(bytes(c[a : a + n]))
        texts += [base[:370], base[:370], base[300:690], base[300:690]]  # equal to their ends, and no windows
        for body, runs, c in zip(texts, substrings.repeated_windows(texts, 400), brute_removed(texts, 400), strict=True):
            assert (as_cover(runs, len(body), 400) == c).all(), seed


def brute_digest(rows, length=400):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[i : i + length]) for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        c = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                c[k] += 1
                c[k + length] -= 1
        c = np.cumsum(c)[:-1] > 0
        out.append((i, len(b), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) > 0).sum()), sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, size):
    path = f"/root/testdata/{size}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    docs = spark.read.parquet(path)
    assert Counter(tuple(r) for r in substrings.removal_digest(docs).collect()) == brute_digest([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rng = random.Random(5)
    noise = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    long = noise(30_000)
    rows = [(1, noise(900))] * 3 + [(2, noise(900)), (None, long), (None, long[:20_000] + noise(500)), (3, noise(800) + long[5_000:5_500]), (3, noise(700)), (4, None), (5, ""), (None, noise(500))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs int, key int").repartition(3)
    assert Counter(tuple(r) for r in substrings.removal_digest(df).collect()) == brute_digest(rows)


def test_very_common_passage(spark):
    """Many different surroundings of one passage, and of parts of it, split down to single windows."""
    rng = random.Random(6)
    noise = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passage = noise(520)
    rows = [(i, noise(rng.randint(0, 200)) + passage[rng.randint(0, 60) : 520 - rng.randint(0, 60)] + noise(rng.randint(0, 200))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4_000, 5, 1):
        kept = substrings.remove_repeats(df, hot=hot)
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha256(bytes(r.kept)).hexdigest()) for r in kept.collect())
        assert got == brute_digest(rows), hot
