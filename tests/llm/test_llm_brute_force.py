"""Models and the pipeline against plain Python on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from examlake.llm import bpe, language_id, license_scan, quality, toxicity
from examlake.llm.common import held_out
from examlake.llm.words import seeded

WORDS = "den haus tag abend morgen wind grün straße night light river stone house tree".split()


def some_texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "!"]) for _ in range(rng.randint(3, 25))) for _ in range(n)]


def kneser_ney(texts):
    """A function that gives nats per character of a text under interpolated Kneser-Ney of the texts' characters."""

    def grams(word):
        w = " " + word + " "
        for i in range(1, len(w)):
            for n in range(1, min(4, i + 1) + 1):
                yield n, w[i + 1 - n : i + 1], i == n - 1

    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    seen, begins = Counter(), set()
    for t in texts:
        for w in words(t):
            for n, g, first in grams(w):
                seen[n, g] += 1
                if first:
                    begins.add((n, g))
    left = Counter((n - 1, g[1:]) for n, g in seen if n > 1)
    c = {k: v if k[0] == 4 or k in begins or k not in left else left[k] for k, v in seen.items()}
    discount, total, types = {}, Counter(), Counter()
    for n in range(1, 5):
        one, two = (sum(v == k for (m, _), v in c.items() if m == n) for k in (1, 2))
        discount[n] = one / (one + 2 * two) if one and two else 0.5
    for (n, g), v in c.items():
        total[n, g[:-1]] += v
        types[n, g[:-1]] += 1

    def p(n, g):
        if n == 0:
            return 1 / (types[1, ""] + 1)
        if not total[n, g[:-1]]:
            return p(n - 1, g[1:])
        d = discount[n]
        return max(c.get((n, g), 0) - d, 0) / total[n, g[:-1]] + d * types[n, g[:-1]] / total[n, g[:-1]] * p(n - 1, g[1:])

    def entropy(t):
        nats, size = 0.0, 0
        for w in words(t):
            padded = " " + w + " "
            for i in range(1, len(padded)):
                n = min(4, i + 1)
                nats -= math.log(p(n, padded[i + 1 - n : i + 1]))
                size += 1
        return nats / max(size, 1)

    return entropy


def test_kneser_ney_against_plain_python(spark):
    texts = some_texts(12)
    langs = ["aa" if i % 3 else "bb" for i in range(12)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string").repartition(3)
    models = {lang: kneser_ney([t for t, x in zip(texts, langs, strict=True) if x == lang]) for lang in ("aa", "bb")}
    for r in language_id.identify(docs, F.lit(False)).collect():
        want = {lang: m(texts[r.doc_id]) for lang, m in models.items()}
        assert r.lang_pred == min(want, key=want.get) and r.entropy == pytest.approx(want[r.lang_pred], rel=1e-5)


def test_letters_keep_the_marks_on_them(spark):
    rows = [(1, "नमस्ते दुनिया"), (2, "1 ़़ 2"), (3, "été 12"), (4, "́́")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", language_id.letters(F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in got} == {1: "नमस्ते दुनिया", 2: "", 3: "été", 4: ""}


def test_random_indexing_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(quality, "VOCABULARY", 12)
    texts = [*some_texts(10, 3), "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    units, vectors, weights = quality.word_vectors(docs)
    assert 0 < len(units.words) <= 12
    index = units.index_vectors().astype(int)
    assert (np.abs(index).sum(1) == quality.SIGNS).all()
    total, seen = np.zeros((units.size, quality.DIMS)), np.zeros(units.size)
    for t in texts:
        word, shape, _ = units.of(pa.array([t]))
        for i in range(len(word)):
            for u in (word[i], shape[i]):
                seen[u] += 1
                for j in range(max(0, i - 2), min(len(word), i + 3)):
                    if j != i:
                        total[u] += index[word[j]] + index[shape[j]]
    logs = np.sign(total) * np.log1p(np.abs(total))
    assert np.allclose(vectors, logs / np.maximum(np.linalg.norm(logs, axis=1, keepdims=True), 1e-9), atol=1e-6)
    made = quality.pooled(pa.array(texts), units, vectors, weights)
    for t, row in zip(texts, made, strict=True):
        word, shape, _ = units.of(pa.array([t]))
        parts = [np.array([vectors[u] * weights[u] for u in kind]).reshape(-1, quality.DIMS) for kind in (word, shape)]
        mean = [x.mean(0) if len(x) else np.zeros(quality.DIMS) for x in parts]
        spread = [x.std(0) if len(x) else np.zeros(quality.DIMS) for x in parts]
        assert np.allclose(row, np.concatenate([*mean, *spread, [np.log1p(len(word))]]), atol=1e-3)


def test_the_most_frequent_words_have_vectors_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(quality, "VOCABULARY", 3)
    docs = spark.createDataFrame([(1, "a a a a a a a a b b b b c c d"), (2, "e")], "doc_id long, text string")
    want = {int(h) for h in quality.word_spans(pa.array(["a b c"]), lower=False)[3]}
    assert set(quality.vocabulary(docs).tolist()) == want


def test_convolution_against_plain_python(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    net, rng = toxicity.ConvNet(), np.random.default_rng(2)
    net.tables[:] = rng.normal(0, 1, net.tables.shape)
    net.bias = [rng.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    texts = [*some_texts(6, 5), "", "one", "one two"]
    ids, offsets = toxicity.word_parts(pa.array(texts))
    got, place = net.maxima(ids, offsets, where=True)
    for k in range(len(texts)):
        own = np.array([np.concatenate([net.tables[p, i[p]] for p in range(toxicity.PARTS)]) for i in ids[offsets[k] : offsets[k + 1]]]).reshape(-1, toxicity.PARTS * toxicity.DIMS)
        want = []
        for w, filters, bias in zip(toxicity.WIDTHS, net.filters, net.bias, strict=True):
            padded = np.concatenate([own, np.zeros((w - 1, own.shape[1]))])
            values = [np.concatenate(padded[i : i + w]) @ filters + bias for i in range(len(own))]
            want.append(np.max([np.zeros(toxicity.FILTERS), *values], axis=0))
        assert np.allclose(got[k], np.concatenate(want), atol=1e-4)
    assert ((place >= 0) == (got > 0)).all()


def test_license_suppression_against_plain_python(spark):
    rules = license_scan.rules()
    pieces = ["gnu lesser general public license version 2 1 or later", "general public license", "cc by sa 4 0", "cc by", "gplv2", "mit license", "under the mit license", "apache license version 2 0", "public domain", "into the public domain", "all rights reserved", "copyright 2020", "the", "code", "bsd 3 clause"]
    rng = random.Random(6)
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(120)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        line = f" {t} "
        spans = sorted({(m.start(), -m.end(), r.priority, k, r.label) for k, r in enumerate(rules) for m in re.finditer(r.pattern, line)})
        kept = {s[4] for n, s in enumerate(spans) if not any(o[2] <= s[2] and o[0] <= s[0] and o[1] <= s[1] for o in spans[:n])}
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == kept | base, t
        best = min([s[2] for s in spans], default=None)
        assert got[i].score == max(license_scan.WEIGHTS[best] if best else 0.0, license_scan.WEIGHTS[3] if base else 0.0)


def shingles(text):
    w = text.encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(min(len(w), 1), len(w) - 4)))


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(12)
    stems = [a + b for a in ("the", "er", "ing", "on", "st", "re") for b in ("wal", "mod", "tan", "pri")]
    say = lambda n: " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))
    items = [say(20) for _ in range(3)]
    clean = [say(rng.randint(40, 80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, say(40) + " you idiot clown" * 3) for i in range(40)]
    rows += [(200, clean[0]), (201, clean[1].replace(" ", "\n  ")), (202, say(20) + " " + items[0] + " " + say(20)), (203, None), (204, ""), (204, ""), (None, say(50))]
    near = clean[2].split()
    near[-1] = "changed"
    rows += [(205, " ".join(near)), (206, say(4)), (207, items[1].upper())]
    docs = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _length string, item_id int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i, _ in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    known = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(*known, "toxic", held_out(F.col("doc_id"), 5, 0)).collect() if r.predicted}
    assert set(range(100, 140)) <= toxic and len(toxic & set(range(60))) <= 3
    left = [(i, t or "") for i, t in rows if i not in toxic]
    best = {}
    for i, t in left:
        best.setdefault(re.sub(r"\s", "", t), []).append((-len(t), i is None, i or 0, i, t))
    left = [min(g)[3:] for g in best.values()]
    owner = list(range(len(left)))
    sets = [shingles(t) for _, t in left]
    for a in range(len(left)):
        for b in range(a):
            total = sum((sets[a] | sets[b]).values())
            if total and sum((sets[a] & sets[b]).values()) >= 0.8 * total:
                owner = [owner[b] if o == owner[a] else o for o in owner]
    classes = defaultdict(list)
    for k, o in enumerate(owner):
        classes[o].append((left[k][0] is None, left[k][0] or 0, left[k]))
    left = [min(c)[2] for c in classes.values()]
    left = [(i, t) for i, t in left if not any(x in t.lower() for x in items)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t in left:
        ids = library.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want
    assert {202, 207}.isdisjoint({r.doc_id for r in got}) and len(got) > 52


def test_pipeline_on_an_empty_table_and_without_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
