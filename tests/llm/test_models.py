"""Language and toxicity models: held-out accuracy, exact sums, gradients, odd inputs."""

import math
import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidlake.llm import language, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "fr": "le ou é eau re en ai que on è ê ie la de ç ment tion".split(), "de": "sch ein er ich ung ö ü der keit ß ver ge be ch heit".split()}


def sentence(rng, lang, k):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(k)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 80)), lang) for i in range(600)]


def test_language(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([*corpus, (1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "Жизнь это " * 30, None), (1004, "a", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(3)
    model = language.train(df.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.language for r in language.identify(df, model).collect()}
    held = [(d, lang) for d, _, lang in corpus if d % 3 == 1]
    assert np.mean([got[d].lang_pred == lang for d, lang in held]) > 0.98
    assert np.mean([got[d].rejected for d, _ in held]) < 0.01
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].rejected and all(0 <= g.score <= 1 for g in got.values())
    nothing = language.train(df.limit(0))
    assert {r.language.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_kneser_ney_sums_to_one():
    symbols, offsets = language.encoded(["the hat and the band on the hand", "ab ba abba"])
    codes, n = np.unique(language.grams(symbols)[language._inside(symbols, offsets)], return_counts=True)
    model = language.LanguageModel(["x"], [codes], [n])
    context = codes[5] >> np.uint64(16)
    every = (context << np.uint64(16)) | np.arange(0x10000, dtype=np.uint64)
    assert np.exp(model._worked_out(every).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    assert np.allclose(model.log_probabilities(every)[:, 0], model._worked_out(every)[:, 0])


def test_language_keeps_all_grams(spark, monkeypatch):
    """Over the former 100,000 grams a language, the model of tables in files equals the one of all counts in memory, whatever the cache holds."""
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    rows = [(i, "".join(rng.choices(letters, k=12_000)), "zh") for i in range(10)] + [(100 + i, sentence(rng, "en", 40), "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts = language.count_grams(df).collect()
    of = {lang: [(r.gram, r.n) for r in counts if r.lang == lang] for lang in ("en", "zh")}
    assert len(of["zh"]) > 100_000
    codes = [np.array([g for g, _ in of[lang]], np.int64).view(np.uint64) for lang in of]
    want = language.LanguageModel(["en", "zh"], codes, [np.array([n for _, n in of[lang]]) for lang in of])
    got = language.train(df)
    every = np.concatenate([*codes, np.random.default_rng(1).integers(1, 1 << 63, 1000, dtype=np.uint64)])
    assert np.array_equal(got._worked_out(every), want._worked_out(every))
    texts = [t.lower() for _, t, _ in rows]
    x, _ = got.cross_entropies(texts)
    monkeypatch.setattr(language, "CACHE_BYTES", 0)
    assert np.array_equal(pickle.loads(pickle.dumps(got)).cross_entropies(texts)[0], x)


def test_tables_on_a_store_that_only_spark_opens(spark, corpus, tmp_path, monkeypatch):
    """With the shared folder on a file system of Spark's own, the model and its predictions are those of a local folder."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./kept", f"file://{tmp_path}")
    df = spark.createDataFrame([*corpus[:200], (-1, None, "en"), (-2, "", "fr")], "doc_id long, text string, lang string").repartition(3)
    want = language.train(df)
    monkeypatch.setattr("evidlake.llm.common.shared_dir", lambda _: "viewfs://own/kept")
    monkeypatch.setattr(language, "shared_dir", lambda _: "viewfs://own/kept")
    got = language.train(df)
    assert all(t.pieces[0][1].startswith("viewfs://own/kept/") for levels in got.orders for *tables, _ in levels for t in tables)
    assert (got.temperature, got.median.tolist(), got.spread.tolist()) == (want.temperature, want.median.tolist(), want.spread.tolist())
    assert sorted(map(str, language.identify(df, got).collect())) == sorted(map(str, language.identify(df, want).collect()))


def test_counting_hands_on_what_it_holds(spark, corpus, monkeypatch):
    """Counts, files and models don't depend on how many grams a task holds or how many rows a file has."""
    df = spark.createDataFrame([*corpus[:200]], "doc_id long, text string, lang string").repartition(2)
    sums = lambda: sorted(map(tuple, language.count_halves(df).select("lang", "gram", "n", "n0", "n1").collect()))
    want, model = sums(), language.train(df)
    assert all(n == a + b for *_, n, a, b in want)
    monkeypatch.setattr(language, "HELD_GRAMS", 10)
    monkeypatch.setattr(language, "CHUNK_BYTES", 1 << 9)
    monkeypatch.setattr(language, "PIECE_ROWS", 1000)
    assert sums() == want
    small = language.train(df)
    assert len({t.pieces[k][1] for levels in small.orders for *tables, _ in levels for t in tables for k in range(len(t.pieces))}) > 3
    codes = np.array([g for _, g, *_ in want], np.int64).view(np.uint64)
    assert np.array_equal(small._worked_out(codes), model._worked_out(codes)) and small.median.tolist() == model.median.tolist()


def plain_cross_entropies(train, text):
    """Interpolated Kneser-Ney over dictionaries, from its definition."""
    out = {}
    for lang in sorted({lang for _, lang in train}):
        levels = [{}, {}, {}, {}]
        for own in (t for t, g in train if g == lang):
            for i in range(3, len(own)):
                levels[3][own[i - 3 : i + 1]] = levels[3].get(own[i - 3 : i + 1], 0) + 1
        for k in (2, 1, 0):
            for gram in levels[k + 1]:
                levels[k][gram[1:]] = levels[k].get(gram[1:], 0) + 1
        rare = [[sum(n == c for n in level.values()) for c in (1, 2)] for level in levels]
        discounts = [a / (a + 2 * b) if a and b else 0.5 for a, b in rare]
        total, padded = 0.0, " " * 3 + text
        for i in range(3, len(padded)):
            p = 1 / 65536
            for k, level in enumerate(levels):
                context = padded[i - k : i]
                after = [n for gram, n in level.items() if gram[:-1] == context]
                if after:
                    n = level.get(padded[i - k : i + 1], 0)
                    p = (max(n - discounts[k], 0) + discounts[k] * len(after) * p) / sum(after)
            total -= math.log(p)
        out[lang] = total / (len(padded) - 3)
    return out


def test_kneser_ney_and_calibration_by_definition(spark):
    """Cross-entropies, medians and spreads equal those worked out over dictionaries; each row is calibrated by the other half's counts."""
    rng = random.Random(7)
    rows = [(i, " " + sentence(rng, lang, 4).lower().replace(".", "").strip(), lang) for i, lang in enumerate(["en"] * 12 + ["fr"] * 12)]
    rows += [(90, " q", "one"), (91, " zz zz zz zz", "two")]  # languages of one text: in one half only
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(df)
    x, _ = model.cross_entropies([t[1:] for _, t, _ in rows])
    for i, (_, text, _) in enumerate(rows):
        want = plain_cross_entropies([(t, g) for _, t, g in rows], text)
        assert x[i] == pytest.approx([want[g] for g in model.langs if g in want], abs=2e-6)
    halves = [zlib.crc32(t.encode()) % 2 for _, t, _ in rows]
    for lang in ("en", "fr"):
        own = []
        for (_, text, g), h in zip(rows, halves, strict=True):
            if g == lang:
                other = plain_cross_entropies([(t, g2) for (_, t, g2), h2 in zip(rows, halves, strict=True) if h2 != h], text)
                if min(other, key=lambda k: other[k]) == lang:
                    own.append(other[lang])
        assert len(own) >= 5
        j = model.langs.index(lang)
        assert model.median[j] == pytest.approx(np.median(own), abs=2e-4)
        assert model.spread[j] == pytest.approx(max(0.02, 1.4826 * np.median(np.abs(np.array(own) - np.median(own)))), abs=4e-4)
    assert np.isinf(model.spread[model.langs.index("two")])


def test_toxicity(spark, corpus):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    bad = ["idiot", "scum", "moron"]
    rows = []
    for i, text, lang in corpus:
        toxic = rng.random() < 0.2
        w = text.split()
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad) if lang == "en" else "ächx" + rng.choice(SYLLABLES[lang]))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (2002, "the " * 20000)], "doc_id long, text string").withColumn("labels", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 5] + [(3000, 1), (2000, None)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled(df, labels, F.lit(True)))
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    held = [(got[i] >= 0.5, bool(x)) for i, _, x in rows if i % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[2000] < 0.5 and got[2001] < 0.5
    assert toxicity.train(toxicity.labelled(df, labels.limit(0), F.lit(True))).scores(toxicity.pa.array(["x"])).tolist() == [0.0]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_with_empty_training_texts(spark):
    """Null and empty labelled texts first, next to each other and last, under ids of their own and repeated: labels of the others stay in place."""
    rows = [(i, f"du {'idiot' if i % 2 else 'freund'} wort{i % 7} und {'dummer' if i % 2 else 'guter'} satz{i % 5}", i % 2) for i in range(10, 90)]
    odd = [(0, None, 0), (1, "", 0), (30, "", 1), (31, None, 0), (31, "", 0), (31, "", 0), (95, "", 0), (96, None, 1), (97, "", 0)]
    some = sorted([*rows, *odd], key=lambda r: r[0])
    model = toxicity.fit([t for _, t, _ in some], np.array([y for *_, y in some]))
    scores = model.scores(pa.array([t for _, t, _ in rows]))
    y = np.array([y for *_, y in rows], dtype=bool)
    assert scores[y].min() > scores[~y].max()
    docs = spark.createDataFrame([r[:2] for r in some], "doc_id long, text string")
    labels = spark.createDataFrame(sorted({(i, 0, y) for i, _, y in some}), "doc_id long, quality int, toxic int")
    trained = toxicity.train(toxicity.labelled(docs, labels, F.lit(True)))
    found = toxicity.score(docs, trained).select("doc_id", "toxicity").collect()
    assert len(found) == len(some) and all(0 <= r.toxicity <= 1 for r in found)
    means = [np.mean([r.toxicity for r in found if r.doc_id in {i for i, _, y in rows if y == k}]) for k in (0, 1)]
    assert means[1] > means[0] + 0.3


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table, index = rng.standard_normal((9, toxicity.INPUT)), rng.integers(0, 9, (5, 6))
    mask = np.arange(6) < np.array([6, 4, 1, 6, 3])[:, None]
    y, weight = np.array([1, 0, 1, 0, 0.0]), np.ones(5)
    _, g, dtable = net.gradients(table, index, mask, y, weight)
    loss = lambda: net.gradients(table, index, mask, y, weight)[0]
    for name, value in [*[(k, net.p[k]) for k in ("wf", "wb", "uf", "ub", "bf", "a", "v", "o")], ("table", table)]:
        at = tuple(rng.integers(0, s) for s in value.shape)
        was, step = value[at], 1e-4
        value[at] = was + step
        up = loss()
        value[at] = was - step
        down = loss()
        value[at] = was
        want = (dtable if name == "table" else g[name])[at]
        assert (up - down) / (2 * step) == pytest.approx(want, rel=0.02, abs=1e-5), name


def test_windows_cover():
    for n in (0, 1, 23, 24, 25, 40, 41, 100):
        own = toxicity.windows_of(n)
        assert own[0][0] == 0 and own[-1][1] == n and all(b - a <= toxicity.WINDOW for a, b in own) and all(b1 >= a2 for (_, b1), (a2, _) in zip(own, own[1:]))
