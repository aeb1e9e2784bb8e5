"""The n-gram join, components and decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidlake.llm import decontamination, ngram_join
from evidlake.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_copies(rng):
    rows, passage = [], " ".join(rng.choices(WORDS, k=60))
    for _ in range(60):
        rows.append(" ".join(rng.choices(WORDS, k=rng.randint(1, 80))))
    for family in range(6):
        base = rng.choices(WORDS, k=rng.randint(40, 120))
        for _ in range((3, 8, 20, 45, 2, 15)[family]):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(" ".join(w))
    rows += [passage + " " + " ".join(rng.choices(WORDS, k=5)) for _ in range(30)] + ["Same Text here now"] * 12 + ["same  text\nHERE now", "a", "A", "a b", "", None, " \t", "é è É"]
    rows += [" ".join(passage.split()[i:]) for i in range(25)]
    return rows


def expect(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("size", "percent", "short"), [(3, 90, 12), (5, 80, 2)])
def test_similar_documents(spark, monkeypatch, size, percent, short):
    texts = near_copies(random.Random(size))
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "LEAST_HOT", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df, size, percent).collect()}
    assert got == expect(texts, size, percent)


@pytest.mark.parametrize("block", [256, 7])
def test_links_of_families(spark, monkeypatch, block):
    """Every link of families of over SHORT_LIST different texts counts, as by brute force."""
    rng = random.Random(block)
    texts = near_copies(random.Random(6))
    for length, k in ((90, 40), (200, 25)):
        base = rng.choices(WORDS, k=length)
        texts += [" ".join([*base[:at], rng.choice(WORDS), *base[at + 1 :]]) for at in rng.choices(range(length), k=k)]
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [frozenset(shingles(t, 3)) for t in texts]
    linked = {s: sum(1 for t in set(sets) if s != t and 100 * len(s & t) >= 90 * len(s | t) and s & t) for s in set(sets)}
    got = {r.doc_id: r.links for r in ngram_join.similar_documents(df, 3, 90).collect()}
    assert got == {i: linked[s] for i, s in enumerate(sets)} and max(got.values()) > ngram_join.SHORT_LIST + ngram_join.ROUNDS


def test_similar_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.similar_documents(df, 3, 90).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (7, 7)]
    assert ngram_join.similar_documents(df.limit(0)).count() == 0
    # Two texts under one doc_id: no row is lost.
    both = spark.createDataFrame([(3, "a b c d e f"), (3, "x y z u v w"), (5, "q r s t u v")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.similar_documents(both, 3, 90).collect()) == [(3, 3), (3, 3), (5, 5)]
    assert ngram_join.one_of_each(df.withColumn("copy", df.doc_id)).columns == ["doc_id", "text", "copy"]


def test_several_texts_under_ids_that_others_share(spark):
    """A document reaches all that any of its texts links with; texts are never lost for another text's copy."""
    rng = random.Random(21)
    texts = near_copies(rng)
    rows = [(rng.randrange(40), t, "x") for t in texts for _ in range(rng.choice([1, 1, 2]))]
    long = [WORDS[i % len(WORDS)] + str(i) for i in range(61)]
    rows += [(101, "one two three four five", "x"), (103, " ".join(long), "x"), (104, " ".join([*long[:-1], long[-1], "more"]), "x"), (102, "one two three four five", "x"), (102, " ".join(long), "x"), (105, None, "x"), (105, "", "x")]
    sets = [(i, frozenset(shingles(t or "", 3))) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets:
        for j, t in sets:
            if i != j and s & t and 100 * len(s & t) >= 90 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string, of string").withColumn("a", F.lit(1)).repartition(5)
    got = ngram_join.similar_documents(df, 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), root(i) if s else i) for i, s in sets)
    linked = {s: sum(1 for t in {s for _, s in sets} if s != t and s & t and 100 * len(s & t) >= 90 * len(s | t)) for _, s in sets}
    assert sorted((r.doc_id, r.n_shingles, r.links) for r in got) == sorted((i, len(s), linked[s]) for i, s in sets)
    assert {r.component_id for r in got if r.doc_id in (101, 102, 103, 104)} == {101}
    a, z = (" ".join(f"{k}{i}" for i in range(30)) for k in "az")
    kept = ngram_join.one_of_each(spark.createDataFrame([(1, a), (2, a), (2, z), (3, z)], "doc_id long, text string"), 5, 80)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, a), (2, z)]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(1 << 20, 1 << 28, 500)).astype(np.uint32)
    n = rng.integers(1, 60000, len(cells))
    got = ngram_join.unpack(ngram_join.pack(cells, n, 1 << 20), 1 << 20)
    assert (got[0] == cells).all() and (got[1] == n).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 7), (3, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {5: 5, 7: 5, 9: 5}


def test_leaks(spark):
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "eé", "io", "u", "ar", "on", "it", "er")]
    items = [" ".join(rng.choices(vocab, k=k)) for k in (40, 20, 9, 8, 5, 300)] + [None, ""]
    noise = lambda k: " ".join(rng.choices(vocab, k=k))
    sub = items[0].split()
    for i in range(0, 40, 9):
        sub[i] = "zzz"
    docs = [noise(50) + " " + items[0] + ". " + noise(5), noise(9) + " " + " ".join(sub), items[1].upper() + "!", noise(300), items[2].replace(" ", ", "), None, "", " ".join(items[5].split()[100:140]), " ".join(items[0].split()[:9]) + " q " + noise(20), items[4] + " " + noise(30), items[3]]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, words string").repartition(2)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.find_leaks(d, b, whole_below=0).collect()}
    assert got == {(0, 0): 40, (1, 0): 35, (2, 1): 20, (4, 2): 9, (7, 5): 40, (9, 4): 5, (10, 3): 8}
    kept = decontamination.decontaminate(d, b, whole_below=0)
    assert {r.doc_id for r in kept.collect()} == {3, 5, 6, 8} and kept.columns == d.columns
    assert decontamination.find_leaks(d.limit(0), b).count() == 0 and decontamination.find_leaks(d, b.limit(0)).count() == 0


def test_masks_miss_no_tolerated_substitution():
    for n in range(1, 13):
        masks = [decontamination.ALL_MASKS[m][1] for m in decontamination.masks_of(n)]
        assert all(len(m) == n and "1" in m for m in masks)
        for places in itertools.combinations(range(n), decontamination.tolerated(n)):
            assert any(all(m[p] == "0" for p in places) for m in masks), (n, places)
    for places in itertools.combinations(range(13), 2):
        assert any(all(m[p - at] == "0" for p in places if at <= p < at + len(m)) for m in decontamination.MASKS for at in range(13 - len(m) + 1)), places


def brute_leaks(docs, items):
    """(doc, item): whether some 13 aligned words, or all of a shorter item, agree enough."""
    split = lambda t: re.findall(r"[a-z0-9é]+", (t or "").lower())
    found = set()
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            size = min(13, len(v))
            need = size if size < 8 else -(-80 * size // 100)
            if v and any(sum(x == y for x, y in zip(w[a : a + size], v[b : b + size], strict=True)) >= need for a in range(len(w) - size + 1) for b in range(len(v) - size + 1)):
                found.add((d, i))
    return found


def test_leaks_of_every_length_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "eé", "io", "u", "ar", "on", "it", "er")]
    noise = lambda k: " ".join(rng.choices(vocab, k=k))
    items = [(i, noise(n)) for i, n in enumerate([3, 5, 7, 8, 8, 9, 9, 10, 10, 11, 12, 12, 13, 14, 20, 40])] + [(3, noise(25)), (None, noise(15))]
    docs = []
    for i, (_, item) in enumerate(items * 8):
        w = item.split()
        for p in rng.sample(range(len(w)), min(len(w), rng.choice([0, 1, 1, 2, 2, 3]))):
            w[p] = "zzz"
        docs.append((i // 2 if i % 9 else None, noise(rng.randint(0, 20)) + " " + " ".join(w) + " " + noise(rng.randint(0, 20))))
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, key int, item_id int").repartition(3)
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, items_df, whole_below=0).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 80
    # As registered, items under 8 words are held by whole texts only.
    short = {i for i, t in items if len(t.split()) < 8}
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, items_df).collect()}
    assert {x for x in got if x[1] not in short} == {x for x in brute_leaks(docs, items) if x[1] not in short}


def test_short_items_empty_no_corpus(spark):
    words_of = ["yes", "no way", "one two three", "a b c d", "v w x y z", "six words are still too few", "seven words are one under the bound"]
    rows = [(i, f"well {w} and more of the same, {w}") for i, w in enumerate(words_of)] + [(100 + i, w.upper() + "!") for i, w in enumerate(words_of)] + [(200, None), (201, ""), (202, "yes yes")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(enumerate(words_of)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.find_leaks(d, b).collect()}
    assert got == {(100 + i, i): len(w.split()) for i, w in enumerate(words_of)}
    assert {r.doc_id for r in decontamination.decontaminate(d, b).collect()} == {r[0] for r in rows if not 100 <= r[0] < 200}

def test_leaks_with_null_ids_and_repeated_rows(spark):
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "io", "u", "ar")]
    noise = lambda k: " ".join(rng.choices(vocab, k=k))
    item = noise(20)
    rows = [(None, noise(30)), (None, noise(5) + " " + item), (None, None), (4, noise(40))] + [(5, item)] * 3 + [(5, noise(12)), (6, noise(60_000) + " " + item)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(1, item), (1, item), (1, noise(18)), (None, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.matched for r in decontamination.find_leaks(d, b).collect()} == {(i, j): 20 for i in (None, 5, 6) for j in (1, None)}
    kept = sorted((r.doc_id or -1, r.text or "") for r in decontamination.decontaminate(d, b).collect())
    assert kept == sorted((i or -1, t or "") for i, t in rows if item not in (t or ""))


def test_one_of_each_repeated_and_null_ids(spark):
    a, b, c = (" ".join(WORDS[i : i + 40]) for i in (0, 50, 100))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (None, a, "x"), (None, b, "x"), (None, b, "z"), (3, c, "x"), (4, " ", "x"), (4, " ", "x"), (None, "", "x"), (None, None, "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, of string").withColumn("same_text", F.lit(1)).withColumn("n", F.lit(2)).repartition(4)
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    want = [(1, a), (None, b), (3, c), (4, " "), (4, " "), (None, ""), (None, None), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)
    assert ngram_join.one_of_each(df.limit(0)).count() == 0
