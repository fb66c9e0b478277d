"""Filter audit, URL rules, lexical search and labelled samples, against plain Python on small tables."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from examlake.llm import filter_audit, labelled, lexical_search, url_filter

SCHEMA = "doc_id long, text string, lang string, part string, n long, words string, score long"


def rows_of(rng, n):
    vocabulary = ["alpha", "Beta", "GAMMA", "delta", "été", "naïve", "x1", "42", "ÄÖ", "a$b", "zz"]
    out = []
    for i in range(n):
        kind = i % 6
        words = [rng.choice(vocabulary[: 3 if kind == 1 else None]) for _ in range(rng.choice([0, 3, 199, 200, 201, 240]))]
        if kind == 2:
            words += [f"w{k}" for k in range(210)]
        out.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words), rng.choice(["en", "de", None])))
    text = out[4][1]
    out += [(n, text, "en"), (n + 1, text, None), (n + 1, text, None), (None, text, "en"), (None, None, None), (n + 2, None, "de"), (n + 3, "", "de"), (n + 4, " \x0c ", ""), (n + 5, "x" * 40000, "en")]
    return [(*r, "p", 7, "w", 1) for r in out]


def audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            name
            for name, test in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]), strict=True)
            if test
        )
        docs.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = lambda d, k=k, order=order: any(x in d[0] for x in order[:k])
                here = [d for d in own if f in d[0] and not gone(d)]
                removed_by[f] += len(here)
                out[part, order, k + 1] = (sum(not gone(d) and f not in d[0] for d in own), len(here), sum(f in d[0] and gone(d) for d in own), sum(d[0] == f for d in own), sum(d[1] for d in here), sum(d[2] for d in here))
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1] += (removed_by[f],)
    return out


def test_filter_audit_against_every_order(spark):
    rng = random.Random(2)
    rows = rows_of(rng, 40)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 40, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (9999, 1, 1)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audit(rows, labels)
    for parts in (1, 7):
        got = filter_audit.filter_audit(docs.repartition(parts), known).collect()
        assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want and len(got) == len(want)


def test_filter_audit_of_no_rows_and_no_labels(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(none, labels).count() == 0
    got = filter_audit.filter_audit(spark.createDataFrame([(1, None, None, "p", 1, "", 1)], SCHEMA), labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120 and all(r.good_lost == r.toxic_lost == 0 for r in got)


def test_the_lattice_has_80_edges_and_600_steps():
    edges, steps = filter_audit.edges(), filter_audit.steps()
    assert len({(a, f) for a, f, _ in edges}) == len(edges) == 80 and len(steps) == 600
    through = Counter((a, f) for _, _, a, f in steps)
    assert {(a, f): w for a, f, w in edges} == through


URLS = [
    "http://example.com/en/1", "https://EXAMPLE.com/en/", "https://a.b.example.com/en/x?y#z", "http://www.example.com/en/q", "http://m.www.example.com/en/q", "http://example.com/EN/1", "http://example.com", "http://example.com?x=/en/", "http://com/",
    "http://badexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://x.org/en/", "no scheme", "", None, "a://b://net/es/", "http://x.net:80/es/", "http://u@x.net/es/", "http://x.net./es/", "http://.net/es/", "ftp://net/es", "http://é.net/es/ü", "http://" + "a." * 2000 + "net/es/", "http://net/es/" + "y" * 60000,
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("NET", "/es/ü", "allow"), ("x.org", "/e", "block"), ("x.org", "/e", "allow"), ("com", "/en/12345678", "block"), (None, "/", "block"), ("net", None, "block")]


def verdict(url, rules):
    rest = url.partition("://")[2] if url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h) + len(p), len(h), h.lower() + p, v) for h, p, v in rules if h is not None and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(f[:2] for f in fits)
    own = [f for f in fits if f[:2] == best]
    return host, path, own[0][2], "block" if any(f[3] == "block" for f in own) else "allow"


@pytest.mark.parametrize("bound", [url_filter.INDEX_BYTES, 0])
def test_url_rules_both_ways(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "INDEX_BYTES", bound)
    monkeypatch.setattr(url_filter, "SHARD_BYTES", 200)
    pages = spark.createDataFrame([(i % 20, u, "h", "r", "x") for i, u in enumerate(URLS * 2)] + [(None, "http://net/es/", "h", "r", "x")], "page_id long, url string, host string, rule string, key string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect())
    want = Counter((i % 20, *verdict(u, RULES)) for i, u in enumerate(URLS * 2)) + Counter([(None, *verdict("http://net/es/", RULES))])
    assert got == want
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_equal_digests_of_other_strings_do_no_harm(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: len(k) % 3)
    entries = [(f"h{i}.net", i) for i in range(50)] + [("h7.net", 99)]
    path = tmp_path / "index"
    path.write_bytes(url_filter.packed_arrays(entries, [("é/", 1)], []))
    first, second, third = url_filter.map_file(str(path))
    at, found = first.find(["h7.net", "h8.net", "h8.ne", "h49.net", ""])
    assert sorted(zip(at.tolist(), found.tolist(), strict=True)) == [(0, 7), (0, 99), (1, 8), (3, 49)]
    assert second.find(["é/", "x"])[1].tolist() == [1] and third.find(["é/"])[0].tolist() == []


def best_documents(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counts = [(i, Counter(terms(t))) for i, t, *_ in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("blocks", [(6 << 20, 4096, 1 << 18), (300, 3, 5)])
def test_lexical_search_against_all_scores(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_BYTES", "BLOCK_DOCS", "PART_TERMS"), blocks, strict=True):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(4)
    vocabulary = [a + b for a in ("ab", "CD", "été", "x9", "β") for b in ("", "1", "Z", "ö")]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary[: rng.choice([2, 8, 20])]) for _ in range(rng.choice([0, 1, 5, 60]))), "l", "p", 1, "w", 2) for i in range(90)]
    docs += [(5, docs[5][1], "l", "p", 1, "w", 2), (None, "ab ab CD1", "l", "p", 1, "w", 2), (200, None, "l", "p", 1, "w", 2), (201, "ab " * 20000, "l", "p", 1, "w", 2)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 30])))) for i in range(12)] + [(3, "ab ab ab"), (None, "CD1, x9!"), (50, None), (51, "unseen words"), (52, "!?")]
    table, asked = spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    assert Counter(map(tuple, lexical_search.search(table, asked).collect())) == best_documents(docs, items)
    assert lexical_search.search(table.limit(0), asked).count() == 0 and lexical_search.search(table, asked.limit(0)).count() == 0


def test_bounds_hold_the_exact_score():
    import numpy as np

    rng = np.random.default_rng(1)
    n, docs, terms = rng.integers(1, 5000, 200), 1000, 400000
    m = lexical_search.length_part(n, docs, terms)
    tf = rng.integers(1, 40, 200)
    exact = lexical_search.impact(tf, m)
    level = -(-exact // lexical_search.STEP)
    assert level.max() <= 255
    upper, lower = lexical_search.bounds([(0, 7)], np.array([0, 200]), np.arange(200), level, 200)
    assert (lower <= 7 * exact).all() and (7 * exact <= upper).all() and (upper - lower <= 7 * lexical_search.STEP).all()


def test_a_labelled_sample_takes_one_row_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i % 3}", "en") for i in range(5000)] + [(i, "other", "de") for i in range(2, 40)] + [(None, "x", "en")], "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, y int")
    rows, counts = labelled.labelled_sample(docs, labels, "y", F.lit(False), 100)
    got = [(r.doc_id, r.text, r.lang, r.y) for r in rows.collect()]
    assert len(got) == 39 and len({g[0] for g in got}) == 39 and counts == {0: 19, 1: 20}
    again, _ = labelled.labelled_sample(docs.repartition(3), labels, "y", F.lit(False), 100)
    assert sorted(got) == sorted((r.doc_id, r.text, r.lang, r.y) for r in again.collect())
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 60)
    few, _ = labelled.labelled_sample(docs, labels, "y", F.lit(False), 100)
    assert 0 < few.agg(F.sum(F.octet_length("text"))).first()[0] <= 60
    assert sum(defaultdict(int, counts).values()) == 39
