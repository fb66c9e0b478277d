"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from examlake.llm import arc_warc, bpe, dart_minhash, decontaminate, exact_dedup, language_id, license_scan, pitman_yor, quality, toxicity
from examlake.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, norm string, y int, band long, block long"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words_of(rng, n, stems):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


EN, DE = "the er ing on an st re th wh".split(), "sch ein ung lich keit ver ge zu".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = words_of(rng, 90, EN)
    near = base.split()
    near[40] = "changed"
    out = [
        (1, base), (2, base), (3, base.replace(" ", "\n  ")), (4, " ".join(near)), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "one"), (9, "one"),
        (None, "no id here at all, still a text"), (10, words_of(rng, 20000, EN)), (11, "x" * 50000), (12, "x" * 50000),
    ]
    out += [(100 + i, words_of(rng, 60, EN if i % 2 else DE)) for i in range(120)]
    return [(i, t, "en" if i is None or i % 2 else "de", "s", None, 1, "a", 0, 5, 6) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(rows)] + [(None, 1, 1), (3, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, rows, none, monkeypatch):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0]))
    want = Counter((r[0], min(g := groups[norm(r[1])])[2], len(g), r[0] == min(g)[2], hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
    assert exact_dedup.exact_dedup(none).count() == 0
    for held in (exact_dedup.HELD_BYTES, 1000):
        monkeypatch.setattr(exact_dedup, "HELD_BYTES", held)
        kept = exact_dedup.keep_owners(docs)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        got = kept.collect()
        assert Counter(norm(r.text) for r in got) == Counter(set(groups)) and all(r.doc_id == min(groups[norm(r.text)])[2] for r in got)
    assert exact_dedup.keep_owners(none).count() == 0
    clash = docs.withColumn("_length", F.lit("x")).withColumn("_HASH", F.lit(1))
    assert exact_dedup.keep_owners(clash).columns == clash.columns and exact_dedup.keep_owners(clash).count() == len(groups)


def test_near_duplicates(docs, rows, none):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(min(len(w), 1), len(w) - 4)))

    sets, owner = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            total = sum((a | sets[j]).values())
            if (not total) or sum((a & sets[j]).values()) >= 0.8 * total:
                owner[max(top(i), top(j))] = min(top(i), top(j))
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[top(i)] = min(smallest.get(top(i), 10**9), r[0])
    size = Counter(top(i) for i in range(len(rows)))
    want = Counter((r[0], smallest.get(top(i)), size[top(i)], r[0] == smallest.get(top(i))) for i, r in enumerate(rows))
    assert Counter(map(tuple, dart_minhash.near_duplicates(docs).collect())) == want
    assert dart_minhash.near_duplicates(none).count() == 0
    assert dart_minhash.keep_one(docs).columns == docs.columns


def test_near_duplicates_in_a_hot_group_lose_no_link(spark):
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 900)}" for _ in range(150)]
    texts = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 6, 8))):
            w[rng.randrange(150)] = f"z{rng.randint(0, 60)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    import pyarrow as pa

    for i in range(0, 260, 7):
        near = dart_minhash.weighted_jaccard(pa.array([texts[i]] * 260), pa.array(texts)) >= 0.8
        assert all(got[i] == got[j] for j in range(260) if near[j])


def test_decontamination(spark, docs, rows, none):
    item = " ".join(rows[0][1].split()[10:40])
    shifted = item.upper().replace(" ", " - ")
    items = spark.createDataFrame([(1, item), (2, None), (3, "..."), (4, "never seen in any text at all"), (1, item)], "item_id long, text string")
    extra = spark.createDataFrame([(500, "before " + shifted + " after"), (501, "before " + item[:60] + "Q" + item[61:])], "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(extra)
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(some, items).collect()}
    assert {(1, 1, 0), (2, 1, 0), (3, 1, 0), (500, 1, 0), (501, 1, 1)} <= got and {x[0] for x in got} <= {1, 2, 3, 4, 500, 501}
    clash = items.withColumn("doc_id", F.lit(3)).withColumn("places", F.lit("x"))
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(some.withColumn("item_id", F.lit(9)), clash).collect()} == got
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {x[0] for x in got}


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(rows[0][1].split()[i : i + 25])) for i in range(4)], "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.matches(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {tuple(r) for r in decontaminate.matches(docs, items).collect()} == whole
    assert decontaminate.clean(docs, items).count() == len(rows) - len({x[0] for x in whole if x[0]} & {1, 2, 3, 4})


def test_bpe(docs, rows, none):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())) == want
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((r[0], (r[1] or "").encode()) for r in rows)


def test_arc_to_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\n", "é" * 2_000_000, "<p>a</p>"]
    pages = spark.createDataFrame([(i + 1, f"http://h/{i} b" if i != 2 else None, h, "x") for i, h in enumerate(html)] + [(2, "http://h/1 b", "<p>a</p>", "x")], "page_id long, url string, html string, date string")
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i + 1)
    got = arc_warc.round_trip(pages).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 8
    for r in got:
        h = html[r.page_id - 1] or ""
        import base64

        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == r.page_id else ("revisit", first[h]))
    assert arc_warc.round_trip(pages.limit(0)).count() == 0
    # null ids: an original only if all equal payloads lack one
    none = spark.createDataFrame([(None, "u", "p"), (4, "u", "p"), (None, "u", "q")], "page_id long, url string, html string")
    assert sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in arc_warc.round_trip(none).collect())) == [(0, "response", None), (0, "revisit", 4), (4, "response", None)]


def test_license_scan(spark, docs, rows, none):
    some = [
        (1, "Under CC-BY 4.0; cc by! All rights\nreserved. GNU General Public License, version 2 or later"), (2, None), (3, "cc  by"), (4, "cc éby"), (5, "ccby all right reserved"),
        (6, "Licensed under the Apache License, Version 2.0 and the MIT License"), (7, "cc by cc by"), (8, "word " * 5000 + "cc by"),
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    for i, text in some:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)), text
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert {"cc-by-4.0", "gpl-2.0-or-later"} <= set(got[1].labels.split(",")) and "gpl-2.0" not in got[1].labels.split(",")
    assert {"apache-2.0", "mit"} <= set(got[6].labels.split(",")) and got[2].labels == "" and got[2].score == 0
    names = {"under GPLv2 or later": "gpl-2.0-or-later", "GPLv3 only": "gpl-3.0-only", "LGPLv2.1": "lgpl-2.1", "MPLv2": "mpl-2.0", "the ASL 2.0": "apache-2.0", "gpl3": "gpl-3.0", "EUPL v1.2": "eupl-1.2"}
    spelled = license_scan.license_scan(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in spelled] == list(names.values())
    assert license_scan.license_scan(none).count() == 0 and license_scan.license_scan(docs).count() == len(rows)


def test_pitman_yor(docs, rows, none):
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\0"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    got = pitman_yor.score(docs, held_out(F.col("doc_id"), 7, 2)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    for r in got:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert pitman_yor.score(none, held_out(F.col("doc_id"), 7, 2)).count() == 0


def test_pitman_yor_without_anything_to_learn_from(docs):
    got = pitman_yor.score(docs.limit(20), F.lit(True)).collect()
    assert len(got) == 20 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def in_one_process(texts, learn, bits=2):
    """The model's parts without Spark: (layout, counts, probabilities) of all texts' pairs."""
    import numpy as np
    import pyarrow as pa

    py = pitman_yor
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(learn), pa.array([0] * len(texts)), pa.array([0] * len(texts))], names=["text", "learn", "range", "block"])
    words = [r for b in py._counts(iter([batch])) for r in b.to_pylist() if r["kind"] == 0]
    n, v = sum(r["n"] for r in words), len(words)
    hot = sorted((r["a"], r["n"]) for r in words if r["n"] * py.HOT >= max(n, 1))
    deal, hot_counts = py.Deal(bits, np.array([w for w, _ in hot], np.uint64)), np.array([c for _, c in hot], float)
    customers = np.zeros(1 << py.context_bits())
    for r in words:
        customers[r["b"]] += r["n"]
    asked = pa.Table.from_batches(list(py._requests(deal)(iter([batch]))))
    replies = []
    for bucket in sorted(set(asked["bucket"].to_pylist())):
        own = asked.filter(pa.compute.equal(asked["bucket"], bucket))
        replies += py._sample(deal, hot_counts, customers, v)(own).to_pylist()
    sums, tables = np.zeros(py.SAMPLES * (py._PER + 2 * len(hot))), np.zeros((py.SAMPLES, len(customers)))
    for r in replies:
        if r["keys"] is not None:
            np.add.at(sums, r["keys"], r["sums"])
        if r["range"] is not None:
            tables[:, r["range"] << py.RANGE_BITS : (r["range"] + 1) << py.RANGE_BITS] += py._dense(r["data"])
    got, _, contexts, _ = py.tokens(pa.array(texts))
    own = py.Layout(got, contexts, deal)
    totals = py.Totals(n, v, deal, hot_counts, customers, tables, sums)
    count, p = totals.probabilities(own, [py.unpacked(r["data"]) for r in replies if r["block"] is not None])
    return totals, own, count, p


@pytest.mark.parametrize("hot", [2048, 4])
def test_pitman_yor_probabilities_sum_to_one(monkeypatch, hot):
    import numpy as np

    monkeypatch.setattr(pitman_yor, "HOT", hot)
    words = "ab bc ca dd e".split()
    learned = ["ab bc ca ab bc", "bc bc ab", "ca dd ab ab", "", "ab ab ab e"]
    every = [f"{a} {b}" for a in words for b in words] + [""]
    totals, own, _, p = in_one_process(learned + every, [True] * len(learned) + [False] * len(every))
    d, b = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    for k in np.unique(own.context):
        here = own.context == k
        assert here.sum() == len(words) + 1
        rest = 0
        for s in range(pitman_yor.SAMPLES):
            t_par, t_root = totals.sums[s * pitman_yor._PER : (s + 1) * pitman_yor._PER - 1], totals.sums[(s + 1) * pitman_yor._PER - 1]
            root = (b + d * t_root) / (totals.vocabulary + 1) / (b + t_par.sum())
            above = (b + d * t_par[k >> pitman_yor.WORD_BITS]) / (b + totals.parents[s][k >> pitman_yor.WORD_BITS]) * root
            rest += (b + d * totals.tables[s][k]) / (b + totals.customers[k]) * above / pitman_yor.SAMPLES
        assert math.isclose(p[here].sum() + rest, 1, rel_tol=1e-6)


def plain_pitman_yor(texts, sweeps, burn):
    """Mean probabilities of the texts' tokens under the same model, one customer at a time, in plain Python."""
    import pyarrow as pa

    d, b = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    words, _, contexts, _ = pitman_yor.tokens(pa.array(texts))
    seats = list(zip(words.tolist(), contexts.tolist(), strict=True))
    v, rng = len(set(words.tolist())), random.Random(3)
    above = lambda r: None if r == () else () if isinstance(r, str) else str(r >> pitman_yor.WORD_BITS)
    tables, customers, n_tables = {}, Counter(), Counter()

    def probability(r, w):
        if r is None:
            return 1 / (v + 1)
        own = tables.get((r, w), [])
        return (sum(own) - d * len(own) + (b + d * n_tables[r]) * probability(above(r), w)) / (b + customers[r])

    def add(r, w):
        if r is None:
            return
        own = tables.setdefault((r, w), [])
        weights = [x - d for x in own] + [(b + d * n_tables[r]) * probability(above(r), w)]
        k = rng.choices(range(len(weights)), weights)[0]
        customers[r] += 1
        if k == len(own):
            own.append(1)
            n_tables[r] += 1
            add(above(r), w)
        else:
            own[k] += 1

    def remove(r, w):
        if r is None:
            return
        own = tables[r, w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        customers[r] -= 1
        if not own[k]:
            own.pop(k)
            n_tables[r] -= 1
            remove(above(r), w)

    for w, c in seats:
        add(c, w)
    total = Counter()
    for sweep in range(sweeps):
        for w, c in seats:
            remove(c, w)
            add(c, w)
        if sweep >= burn:
            for w, c in set(seats):
                total[w, c] += probability(c, w) / (sweeps - burn)
    return [total[x] for x in seats]


def test_pitman_yor_against_a_plain_sampler(monkeypatch):
    import numpy as np

    rng = random.Random(17)
    stems = [a + b for a in "abcdef" for b in "xyz"]
    texts = [" ".join(stems[min(int(rng.expovariate(0.25)), 17)] for _ in range(25)) for _ in range(30)]
    want = np.array(plain_pitman_yor(texts, 40, 10))
    monkeypatch.setattr(pitman_yor, "SAMPLES", 20)
    _, own, count, p = in_one_process(texts, [True] * len(texts), bits=1)
    got = p[own.place]
    assert abs(np.log10(got).mean() - np.log10(want).mean()) < 0.02
    assert np.abs(np.log10(got) - np.log10(want)).mean() < 0.08


def test_language_id(docs, rows, none):
    held = held_out(F.col("doc_id"), 4, 2)
    got = language_id.identify(docs, held).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (not re.search(r"\w", texts[r.doc_id] or "")) and 0 <= r.score <= 1
    right = [r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id and r.doc_id >= 100]
    assert sum(right) / len(right) > 0.95
    assert language_id.identify(none, held).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(True)).collect()} == {"und"}


def test_language_id_in_parts_is_the_same(docs, rows, monkeypatch):
    held = held_out(F.col("doc_id"), 4, 2)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    want = sorted(language_id.identify(docs, held).collect(), key=key)
    monkeypatch.setattr(language_id, "BLOCK", 1000)
    monkeypatch.setattr(language_id, "LOT", 5000)
    got = sorted(language_id.identify(docs, held).collect(), key=key)
    assert len(got) == len(rows)
    for a, b in zip(got, want, strict=True):
        assert (a.doc_id, a.lang_pred, a.rejected) == (b.doc_id, b.lang_pred, b.rejected)
        assert a.score == pytest.approx(b.score, abs=1e-6) and a.entropy == pytest.approx(b.entropy, abs=1e-6)


def test_language_id_keeps_rare_languages_and_many_letters(spark, monkeypatch):
    rng = random.Random(12)
    hanzi = [chr(0x4E00 + i) for i in range(60)]
    rows = [(i, words_of(rng, 60, EN), "en") for i in range(200)] + [(1000 + i, "".join(rng.choice(hanzi) for _ in range(200)), "zh") for i in range(40)]
    rows += [(2000 + i, words_of(rng, 30, DE), "de") for i in range(6)]
    monkeypatch.setattr(language_id, "BLOCK", 3000)
    monkeypatch.setattr(language_id, "CELLS", 3000, raising=False)
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.col("doc_id") % 5 == 0).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(i, lang) for i, _, lang in rows}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_tables(docs, rows, none, labels, module):
    held = held_out(F.col("doc_id"), 5, 0)
    for some, known, n in ((docs, labels, len(rows)), (docs, labels.limit(0), len(rows)), (none, labels, 0)):
        got = module.score(some, known, "toxic", held).collect()
        assert len(got) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)


def test_few_labels_and_long_labelled_texts_are_learned_from(spark):
    rng = random.Random(4)
    for n, size in ((60, 4200), (9, 30)):
        rows = [(i, words_of(rng, size, EN) + (" you idiot clown" * 3 if i % 2 else " you there"), "en") for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
        labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, toxic int, quality int")
        got = {r.doc_id: r for r in toxicity.score(docs, labels, "toxic", F.lit(False)).collect()}
        assert sum(got[i].predicted == i % 2 for i in range(n)) >= 0.85 * n
        kept = {r.doc_id for r in toxicity.accept(docs, labels, "toxic", F.lit(False)).collect()}
        assert kept == {i for i in range(n) if not got[i].predicted}
        good = quality.score(docs, labels, "quality", F.lit(False)).collect()
        assert sum((r.score >= 0.5) == r.doc_id % 2 for r in good) >= 0.85 * n
    # labels of one kind tell nothing apart
    assert toxicity.accept(docs, labels.where("toxic = 1"), "toxic", F.lit(False)).count() == 9


def test_classifiers_learn_what_marks_a_label(spark):
    rng = random.Random(11)
    bad = [i % 3 == 0 for i in range(600)]
    rows = [(i, words_of(rng, 40, EN) + (" you idiot clown" if b else " you there") + words_of(rng, 5, EN), "en") for i, b in enumerate(bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(b), int(not b)) for i, b in enumerate(bad)], "doc_id long, toxic int, quality int")
    held = held_out(F.col("doc_id"), 5, 0)
    got = [r for r in toxicity.score(docs, labels, "toxic", held).collect() if r.held_out]
    assert sum(r.predicted == bad[r.doc_id] for r in got) / len(got) > 0.95
    kept = toxicity.accept(docs, labels, "toxic", held)
    assert kept.columns == docs.columns and abs(kept.count() - 400) < 20
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", " ", "!! ")).otherwise(F.col("text")))
    got = [r for r in quality.score(marked, labels, "quality", held).collect() if r.held_out]
    assert sum((r.score >= 0.5) == (not bad[r.doc_id]) for r in got) / len(got) > 0.95
