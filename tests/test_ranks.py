"""Orders, chain checks, approvals and percentiles of hot keys, in small segments, against plain recomputations."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidlake.operators import events, graph, metrics, ranks


def test_ranked(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.randrange(50) if r.random() < 0.9 else None, i) for i in range(800)]
    df = spark.createDataFrame(data, "k string, at int, id int").repartition(6)
    got = ranks.ranked(df, ["k"], ["at", "id"])
    assert got.columns == ["k", "at", "id", "rank"]
    want = []
    for key in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == key), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        want += [(*d, k + 1) for k, d in enumerate(own)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_hot_key_spreads(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    with_ranges = df.repartitionByRange(4, "k", "at").withColumn("range_of_rows", F.spark_partition_id())
    assert with_ranges.groupBy("range_of_rows").count().count() == 4
    found = ranks.in_order(graph.cut_lineage(with_ranges), ["k"], ["at"], "range_of_rows", "at")
    assert found.where("rank <> at + 1 or not (prior <=> nullif(at, 0) - 1)").isEmpty() and found.count() == 4000


@pytest.mark.parametrize("rows", [1 << 16, 3])
def test_chains_in_segments(spark, monkeypatch, rows):
    monkeypatch.setattr(events, "SEGMENT_ROWS", rows)
    r = random.Random(rows)
    data = []
    for s in range(60):
        n = r.choice([1, 4, 30])
        own = [[s, i, f"{s}h{i}", f"{s}h{i - 1}" if i else None, f"{s}h{i}"] for i in range(n)]
        kind, at = r.randrange(7), r.randrange(n)
        if kind == 0:
            own[at][4] = "other"
        elif kind == 1 and at:
            del own[at - 1]
        elif kind == 2:
            own[at][3] = "wrong"
        elif kind == 3:
            own.append([s, at, f"{s}z{at}", own[at][3], f"{s}z{at}"])
        elif kind == 4:
            own[at][1] = None
        data += own
    df = spark.createDataFrame(data, "session_id int, sequence long, event_hash string, previous_event_hash string, own_hash string").repartition(5)
    heads = spark.createDataFrame([(s, f"{s}h{29}") for s in range(0, 70, 2)], "session_id int, head_hash string")
    got = {x.session_id: (x.outcome, x.n_events) for x in events.verify_sessions(df, heads, F.col("own_hash")).collect()}
    held = dict(map(tuple, heads.collect()))
    for s in range(70):
        own = sorted((d for d in data if d[0] == s), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        code = None
        for k, (_, q, h, p, o) in enumerate(own):
            prior = own[k - 1][2] if k else None
            code = code or ("EVENT_HASH_MISMATCH" if h != o else "SEQUENCE_GAP" if q is not None and q != k else "PREVIOUS_HASH_MISMATCH" if p != prior else None)
        if not own:
            assert got.get(s) == (("MISSING_SESSION", 0) if s in held else None)
            continue
        top = max((d for d in own if d[1] is not None), key=lambda d: d[1], default=None)
        tops = {d[2] for d in own if top and d[1] == top[1]} or {None}
        want = {code or ("NO_TRUSTED_HEAD" if s not in held else "HEAD_MISMATCH" if held[s] != t else "VERIFIED") for t in tops}
        assert got[s][0] in want | ({"VERIFIED"} if tops == {None} else set()) and got[s][1] == len(own), s


@pytest.mark.parametrize("rows", [1 << 16, 2])
def test_append_in_segments(spark, monkeypatch, rows):
    monkeypatch.setattr(events, "SEGMENT_ROWS", rows)
    schema = "session_id int, sequence long, event_hash string, previous_event_hash string"
    chain = lambda s, a, b: [(s, i, f"{s}h{i}", f"{s}h{i - 1}" if i else None) for i in range(a, b)]
    log = chain(1, 0, 4) + chain(2, 0, 2) + chain(4, 0, 3)
    new = chain(1, 2, 9) + [x for x in chain(2, 2, 9) if x[1] != 5] + chain(3, 0, 5) + [(4, 3, "4h3", "wrong"), (4, 4, "4h4", "4h3"), (1, 3, "fork", "1h2")]
    ok, bad = events.chain_append(spark.createDataFrame(new + new[:3], schema).repartition(3), spark.createDataFrame(log, schema))
    assert sorted(tuple(x)[:2] for x in ok.collect()) == [*[(1, i) for i in range(4, 9)], *[(2, i) for i in range(2, 5)], *[(3, i) for i in range(5)]]
    assert sorted((x.session_id, x.sequence, x.reject_reason) for x in bad.collect()) == [(1, 3, "FORK"), *[(2, i, "SEQUENCE_GAP") for i in (6, 7, 8)], *[(4, i, "PREVIOUS_HASH") for i in (3, 4)]]


@pytest.mark.parametrize("rows", [1 << 16, 3])
def test_append_deals_rows_once(spark, monkeypatch, rows):
    """Random chains with gaps, forks, doubles and wrong hashes against a plain loop; rows are dealt once for the result and once for the segments' sums."""
    monkeypatch.setattr(events, "SEGMENT_ROWS", rows)
    r, schema, log, new = random.Random(11), "session_id int, sequence long, event_hash string, previous_event_hash string", [], []
    for s in range(60):
        chain = [(s, q, f"{s}h{q}", f"{s}h{q - 1}" if q else None) for q in range(14)]
        cut = r.randrange(6)
        log += chain[:cut]
        own = chain[max(cut - r.randrange(3), 0) :]
        for _ in range(r.randrange(3)):
            k = r.randrange(len(own))
            own[k] = r.choice([own[k][:3] + ("x",), (s, own[k][1], f"{s}f", own[k][3]), (s, own[k][1] + 20, *own[k][2:])])
        new += [x for x in own if r.random() < 0.97] + own[:1]
    held = {x[:2]: x[2] for x in log}
    ok, bad = set(), []
    for s in range(60):
        forks = [x for x in new if x[0] == s and held.get(x[:2], x[2]) != x[2]]
        bad += [(*x[:3], "FORK") for x in forks]
        last = max((q for a, q in held if a == s), default=-1)
        prior, reason = held.get((s, last)), None
        for n, x in enumerate(sorted({x for x in new if x[0] == s and x[:2] not in held}, key=lambda x: x[1:3])):
            reason = reason or ("SEQUENCE_GAP" if x[1] != last + n + 1 else "PREVIOUS_HASH" if x[3] != prior else None)
            prior = x[2]
            bad += [(*x[:3], reason)] if reason else []
            ok |= set() if reason else {x}
    good, rejects = events.chain_append(spark.createDataFrame(new, schema).repartition(3), spark.createDataFrame(log, schema))
    assert {tuple(x) for x in good.collect()} == ok and good.count() == len(ok)
    assert sorted((x.session_id, x.sequence, x.event_hash, x.reject_reason) for x in rejects.collect()) == sorted(bad) and {x[3] for x in bad} == {"FORK", "SEQUENCE_GAP", "PREVIOUS_HASH"}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = events.chain_append(spark.createDataFrame(new, schema), spark.createDataFrame(log, schema))[0]
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_approvals_of_a_hot_digest(spark):
    r = random.Random(5)
    asks = [(i, "hot" if r.random() < 0.5 else f"d{r.randrange(5)}", r.choice(["ASK", "ASK", "ALLOW", "DENY", None]), r.randrange(200)) for i in range(500)]
    have = [(i, "hot" if r.random() < 0.5 else f"d{r.randrange(5)}") for i in range(120)]
    got = {x.invocation_id: (x.outcome, x.approval_id) for x in events.authorize(spark.createDataFrame(asks, "invocation_id int, digest string, verdict string, at int"), spark.createDataFrame(have, "approval_id int, digest string")).collect()}
    left = defaultdict(list)
    for i, d in sorted(have):
        left[d].append(i)
    for i, d, verdict, _ in sorted(asks, key=lambda a: (a[3], a[0])):
        want = ("PASSED", None) if verdict == "ALLOW" else ("APPROVED", left[d].pop(0)) if verdict == "ASK" and left[d] else ("WAITING" if verdict == "ASK" else "BLOCKED", None)
        assert got[i] == want


@pytest.mark.parametrize(("cells", "few"), [(1024, 4096), (3, 2)])
def test_nearest_rank(spark, cells, few):
    r = random.Random(cells)
    shapes = {"same": [7.0] * 90, "one": [3.5], "wide": [10.0 ** r.uniform(-9, 9) for _ in range(300)], "ties": [float(r.randrange(4)) for _ in range(200)], "minus": [-r.random() for _ in range(101)], None: [1.0, 2.0, 3.0], "nulls": [None] * 5 + [1.0, 2.0], "gone": [None, None]}
    data = [(k, v) for k, own in shapes.items() for v in own]
    r.shuffle(data)
    df = spark.createDataFrame(data, "k string, sample double").repartition(4)
    for percent in (1, 50, 95, 100):
        found = metrics.nearest_rank(df, "k", percent, cells, few)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        got = {x.k: (x.n, x.value) for x in found.collect()}
        for k, own in shapes.items():
            ordered = sorted(own, key=lambda v: (v is not None, v or 0))
            assert got[k] == (len(own), ordered[-(-percent * len(own) // 100) - 1]), (k, percent)
    whole = metrics.nearest_rank(df.select("k", F.col("sample").cast("long").alias("sample")).where("k = 'ties'"), "k", 95, cells, few).first()
    assert whole.value == sorted(shapes["ties"])[189]
