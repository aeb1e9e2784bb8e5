"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import random
import re

import pytest

import corpus_pipeline

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    text = lambda k: " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(k))
    items = [text(40), text(20)]
    rows = [(i, text(rng.randint(20, 200)), "en", f"s{i % 3}") for i in range(120)]
    near = rows[5][1].split()
    near[3] = "zzz"
    rows += [(200, rows[4][1], "en", "s0"), (201, " ".join(near) if len(near) > 80 else rows[5][1], "en", "s1"), (202, text(30) + " " + items[0] + " " + text(5), "en", "s2"), (203, "Жизнь это не шутка " * 40, "en", "s0"), (204, None, "en", "s1"), (205, "", None, None), (206, items[1].upper(), "en", None)]
    root = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, {i: t for i, t, _, _ in rows}


def test_stages(spark, corpus):
    root, texts = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    a = corpus_pipeline.languages(spark, docs, root)
    assert a.columns == docs.columns and set(texts) - ids(a) <= {203, 204, 205} and {204, 205} <= set(texts) - ids(a)
    b = corpus_pipeline.near_copies(spark, a, root)
    sets = {i: set(zip(*[re.findall(r"\S+", texts[i].lower())[k:] for k in range(5)], strict=False)) for i in ids(a)}
    copies = {j for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert ids(b) == ids(a) - copies and {200, 201} <= copies
    c = corpus_pipeline.leaks(spark, b, root)
    assert ids(c) == ids(b) - {202, 206}
    m = corpus_pipeline.weights(spark, c, root)
    assert m.columns == docs.columns and ids(m) <= ids(c) and m.count() > 0
    total = sum(len((texts[i] or "").split()) for i in ids(c))
    assert sum(len(r.text.split()) for r in m.collect()) == pytest.approx(total, rel=0.1)
    s = corpus_pipeline.shards(spark, m, root).collect()
    assert len(s) == m.count()
    slots = {}
    for r in s:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_on_empty(spark, corpus, tmp_path):
    root, _ = corpus
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{root}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
