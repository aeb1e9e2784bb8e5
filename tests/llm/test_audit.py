"""Source divergence, URL filters and filter interactions against plain recomputations on small and odd tables."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from evidlake.llm import divergence, filter_audit, url_filter

DOCS = "doc_id long, text string, lang string, source string, term string, value long, part string, mask int"


def rows_of():
    rows = []
    for i in range(90):
        words = [f"{'Wort' if i % 2 else 'mot'}{chr(97 + i * k % 7)}" for k in range(i % 11 + 1)] + (["Éa", "z9z"] if i % 5 == 0 else [])
        rows.append((i, " ".join(words), "de" if i % 2 else "fr", f"s{i % 6}" if i % 13 else None))
    rows += [(200 + i, "same words of copies AND more", None, "s1") for i in range(12)] + [(None, "same words of copies AND more", None, "s1"), (None, None, None, None)]
    rows += [(300, None, "de", "silent"), (301, "", "de", "s1"), (302, "12 34 $", "xx", "s1"), (303, "a A " * 20000, "de", "s2"), (304, "tab\tand\x0bfeed", "fr", "s2"), (205, "same words of copies AND more", None, "s3")]
    return [(*r, "extra", 1, "p", 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), DOCS).repartition(5)


def brute_divergence(rows, least, top):
    groups, cf, df = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        cf[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        share = {}
        for s in (*sources, None):
            count = Counter({t: sum(cf[lang, x][t] for x in sources) for t in kept}) if s is None else cf[lang, s]
            n = sum(count[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(share[None][t] - share[s][t], t.encode(), t) for t in kept if cf[lang, s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("tile", "rows", "least"), [(256, 1 << 18, 5), (2, 7, 5), (2, 7, 1), (256, 1 << 18, 10**6)])
def test_divergence(docs, monkeypatch, tile, rows, least):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TILE_ROWS", rows)
    got = [tuple(r) for r in divergence.source_divergence(docs, least, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows_of(), least, 3)


def test_divergence_runs(docs):
    """Blocks that fill at once and shards of few rows give the same frequencies."""
    want = {tuple(r) for r in divergence.term_frequencies(docs).collect()}
    assert {tuple(r) for r in divergence.term_frequencies(docs, block_bytes=500, shard_rows=20).collect()} == want
    assert ("same", "", "s1", 13, 13) in want and ("", "de", "silent", 0, 1) in want and ("a", "de", "s2", 40000, 1) in want
    assert divergence.source_divergence(docs.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, host string, n long, rule string"


def pages_of():
    link = lambda *hosts: "<p>" + "".join(f'<A HREF = "https://{h}/x">x</a> <img src=a href=//{h}>' for h in hosts) + '<a href="/own">o</a></p>'
    rows = [(i, f"http://Hub.org/p/{i}", link(*(f"h{k}.org" for k in range(i, i + 4)))) for i in range(30)]
    rows += [(100 + i, f"https://h{i}.org/a?b#c", link("bad.net", "hub.org") if i % 3 == 0 else link("www.example.com")) for i in range(12)]
    rows += [(200 + i, f"http://bad.net/{p}", link("spam.info", "h1.org")) for i, p in enumerate(("es/1", "fr/2", "en/3"))] + [(210, "http://spam.info", link("bad.net")), (211, "http://spam.info/", None)]
    rows += [(220, "http://www.example.com/en/1", link("hub.org")), (221, "http://example.com/en/", None), (222, "http://m.example.com/en/x", ""), (223, "http://notexample.com/en/", ""), (224, "ftp://com/", None), (225, "http://x.com?q=/", ""), (226, "http://y.com", "")]
    rows += [(300, None, link("hub.org")), (301, "no scheme", None), (302, "://", ""), (303, "x://?a", ""), (220, "http://www.example.com/en/1", link("hub.org")), (304, "a://b://c/d", "")]
    return [(*r, "clash", 1, "r") for r in rows]


def brute_pages(pages, rounds=url_filter.ROUNDS):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    judged = []
    for page, url, html, *_ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append((page, host, path, html, *(max(fits)[1:] if fits else (None, None))))
    n, good, bad = (Counter(j[1] for j in judged if j[1] and (v is None or j[5] == v)) for v in (None, "allow", "block"))
    edges = Counter()
    for _, host, _, html, *_ in judged:
        for to in re.findall(r"""[ \t-\r"']href[ \t-\r]*=[ \t-\r]*["']?(?:https?:)?//([^/?#"'> \t-\r]+)""", html or "", re.I):
            if host and lower(to) != host:
                edges[host, lower(to)] += 1
    for host in n:
        above = [host.split(".", k)[k] for k in range(1, host.count(".") + 1)]
        near = next((a for a in above if a in n), None)
        if near:
            edges[host, near] += 1
            edges[near, host] += 1
    one = 10**12
    trust0, bad0 = ({h: c[h] * one // n[h] * 15 // 100 for h in n} for c in (good, bad))
    out_of, into = Counter(), Counter()
    for (a, b), k in edges.items():
        out_of[a] += k
        into[b] += k
    trust, distrust = dict(trust0), dict(bad0)
    for _ in range(rounds):
        t, d = Counter(), Counter()
        for (a, b), k in edges.items():
            t[b] += trust.get(a, 0) * k // out_of[a]
            d[a] += distrust.get(b, 0) * k // into[b]
        hosts = {*n, *t, *d}
        trust, distrust = ({h: own.get(h, 0) + got[h] * 85 // 100 for h in hosts} for own, got in ((trust0, t), (bad0, d)))
    found = lambda h: "block" if distrust.get(h, 0) > trust.get(h, 0) and distrust[h] >= one * 75 // 1000 else "allow"
    return sorted(((p, h, path, rule or "", v or found(h), trust.get(h, 0), distrust.get(h, 0)) for p, h, path, _, rule, v in judged), key=str)


@pytest.mark.parametrize("hub", [10_000, 2])
def test_url_filter(spark, monkeypatch, hub):
    monkeypatch.setattr(url_filter, "HUB", hub)
    df = spark.createDataFrame(pages_of(), PAGES).repartition(3)
    got = sorted(((*r[:3], r[3] or "", *r[4:]) for r in map(tuple, url_filter.judge_pages(df).collect())), key=str)
    assert got == brute_pages(pages_of())
    verdict = {(r[0], r[4]) for r in got}
    assert {(202, "block"), (0, "block"), (221, "block"), (220, "allow"), (300, "allow"), (301, "allow"), (224, "allow")} <= verdict  # the hub's links lead to hosts that link to bad.net
    assert url_filter.judge_pages(df.limit(0)).count() == 0


LABELS = "doc_id long, quality int, toxic int, source string"


def test_filter_audit(spark, docs):
    marks = [(i, i % 3 and 1, i % 4 and 1, "x") for i in range(0, 90, 2)] + [(205, 1, 0, "x"), (205, 0, 1, "x"), (None, 1, 1, "x"), (9999, 1, 1, "x"), (303, None, 1, "x")]
    rows = rows_of() + [(400 + i, " ".join(f"w{k * (i + 1) % 251}" for k in range(190 + i * 10)) + ("# " if i % 2 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * i), "de", f"s{i % 3}", "e", 1, "p", 1) for i in range(8)]
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    found = []
    for doc_id, text, _, source, *_ in rows:
        words, text = re.findall(r"[^\x20\x09-\x0D]+", text or ""), text or ""
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and first[text] < doc_id}
        own = [m for m in marks if doc_id is not None and m[0] == doc_id]
        found.append((source or "", {f for f, x in fails.items() if x}, any(m[1] == 1 for m in own), any(m[2] == 1 for m in own)))
    want, shapley = {}, Counter()
    for part in {f[0] for f in found}:
        for order in permutations("ABCDE"):
            left = [f for f in found if f[0] == part]
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                fails = [f for f in found if f[0] == part and name in f[1]]
                shapley[part, name] += len(gone)
                want[part, "".join(order), step] = (len(left), len(gone), len(fails) - len(gone), sum(len(f[1]) == 1 for f in fails), sum(f[2] for f in gone), sum(f[3] for f in gone))
    got = filter_audit.filter_audit(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(marks, LABELS)).collect()
    assert len(got) == len(want)
    for r in got:
        key = (r.part, r.filter_order, r.step)
        assert tuple(r)[3:] == (*want[key], shapley[r.part, r.filter_order[r.step - 1]])
    assert filter_audit.filter_audit(docs.limit(0), spark.createDataFrame(marks, LABELS)).count() == 0


def test_path_counts():
    for n in (1, 3, 5):
        reach, leave = filter_audit.path_counts(n)
        orders = list(permutations(range(n)))
        for s in range(1 << n):
            size = bin(s).count("1")
            through = sum(set(o[:size]) == {f for f in range(n) if s >> f & 1} for o in orders)
            assert reach[s] * leave[s] == through
    with pytest.raises(ValueError, match="filters"):
        filter_audit.lattice(None, "ABCDEFG")
