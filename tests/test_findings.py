"""What the reviews of the third and fourth round found, each on a small table."""

import hashlib
import inspect
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from examlake.functions import unicode
from examlake.functions.text import find_all
from examlake.llm import language_id, toxicity
from examlake.llm.labelled import known_labels
from examlake.operators import checks, cuts, folds, layout, lookups, merge
from examlake.plans import registry
from examlake.sources.tables import answers

SF = "/root/testdata/sf0.001"


def test_a_function_and_its_argument_are_reported_as_flattened(spark):
    none = "array<struct<key:string,text:string,math:array<string>>>"
    tables, math = F.array().cast("array<struct<id:int,cont_of:int,widths:array<int>>>"), F.array().cast("array<string>")
    found = checks.question_faults(F.col("t"), F.array().cast(none), F.lit("解答题"), F.lit(None).cast("int"), tables, F.lit(None).cast("string"), math)
    rows = spark.createDataFrame([(1, "n that ndesin 55.130. and more words"), (2, "no formula in here, only plain words")], "i int, t string")
    got = {r.i: [f.message for f in r.f] for r in rows.select("i", found.alias("f")).collect()}
    assert got == {1: ["stem flattened"], 2: []}


def test_intervals_without_an_end_come_last_and_apart(spark):
    rows = spark.createDataFrame([(1, None, None), (1, 1.0, 9.0), (1, 2.0, 12.0), (1, None, None), (2, 5.0, 11.0), (2, 5.0, 11.0), (2, 5.0, 11.0)], "k int, a double, b double")
    got = sorted(tuple(r) for r in layout.connected_intervals(rows, "k", "a", "b").select("k", "group", F.coalesce("a", F.lit(-1.0)), F.coalesce("b", F.lit(-1.0)), "n").collect())
    assert got == [(1, 1, 1.0, 12.0, 2), (1, 2, -1.0, -1.0, 1), (1, 3, -1.0, -1.0, 1), (2, 1, 5.0, 11.0, 3)]


def test_figures_and_labels_are_streamed(spark):
    """No frame is made for each question or scene."""
    for made in (layout.option_figures, layout.place_labels):
        assert "applyInPandas" not in inspect.getsource(made)
    boxes = [(q, f, 1, x + q % 2, top, 10.0, 10.0) for q in range(300) for f, x, top in ((0, 5.0, 200.0), (1, 0.0, 100.0), (2, 20.0, 100.0), (3, 0.0, 85.0), (4, 20.0 + 9 * (q % 3), 85.0))] + [(-1, 9, 1, None, None, None, None)]
    got = layout.option_figures(spark.createDataFrame(boxes, "q int, figure int, page int, x double, top double, w double, h double"), "q", 4)
    assert {(r.q, r.figure) for r in got.collect() if r.is_option} == {(q, f) for q in range(0, 300, 3) for f in range(1, 5)}
    assert got.count() == len(boxes)
    labels = [(s, k, i, 0.0, 0.0, 10.0, 5.0) for s in range(300) for i, k in enumerate("abc")]
    got = {(r.s, r.label): (r.y, r.placed) for r in layout.place_labels(spark.createDataFrame(labels, "s int, label string, seq int, x double, y double, w double, h double"), "s").collect()}
    assert got == {(s, k): (y, True) for s in range(300) for k, y in (("a", 0.0), ("b", 8.0), ("c", 16.0))}


def test_normal_forms_run_over_batches(spark):
    """Forms are no column expressions that search their tables for each character."""
    texts = ["e\u0301x", None, "ﬁ Ａ", "plain", "q\u0323\u0301", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plan = df.select(unicode.normal_form(F.col("t"), "NFC"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    got = df.orderBy("i").select(unicode.normal_form(F.col("t"), "NFC").alias("c"), unicode.normal_forms(F.array("t", F.lit("Ａ"))).alias("k")).collect()
    assert [r.c for r in got] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert [r.k for r in got] == [[None if t is None else unicodedata.normalize("NFKC", t), "A"] for t in texts]


def test_what_costs_much_is_computed_once_for_equal_inputs(spark):
    calls = spark.sparkContext.accumulator(0)

    def shout(t):
        calls.add(1)
        return None if t is None else t.upper()

    rows = spark.createDataFrame([(i, ("a", None, "b")[i % 3]) for i in range(300)], "i int, t string").repartition(3)
    got = lookups.each_once(rows, ["t"], F.udf(shout, "string").asNondeterministic()(F.col("t")), "x").collect()
    assert sorted((r.i, r.x) for r in got) == [(i, ("A", None, "B")[i % 3]) for i in range(300)]
    assert calls.value == 3


def test_language_id_calibrates_on_every_document_to_learn_from(spark):
    # model of one language; cross-entropies 0.01, 0.02, ... 30, known for all but the last
    model = language_id.Model(["aa"], np.zeros(0, np.uint64), np.zeros((1, 1), np.float32), np.ones((1, 1), np.float32), np.zeros(1, np.float32))
    rows = [(i, "aa" if i < 3000 else None, [i / 100], 10) for i in range(1, 3001)]
    measured = spark.createDataFrame(rows, "doc_id long, known string, h array<double>, size long").repartition(3)
    language_id.calibrate(model, measured)
    # of 2,999 documents, the first that 99.5 % do not exceed
    assert model.reject[0] == pytest.approx(29.85)
    assert sum(r.rejected for r in language_id.predict(model, measured).collect()) == 15


def test_streamed_rows_are_dealt_above_a_join_by_their_key(spark):
    """The join may yet be broadcast, which leaves its rows where they are; so its own shuffle is not enough."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000, numPartitions=4).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
        known = spark.range(20, numPartitions=2).select(F.col("id").alias("k"))
        got = folds.streamed(rows.join(known, "k"), "k", ["v"], ["v"], lambda own: [(sum(1 for _ in own),)], "seen long")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and plan.index("REPARTITION_BY_COL") < plan.index("Join")
        assert sorted((r.k, r.seen) for r in got.collect()) == [(k, 200) for k in range(20)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """In blocks of any number, and one row of an id."""
    assert not hasattr(toxicity, "PER_CLASS")
    rows = [(i, f"w{i} you {'idiot' if i % 3 == 0 else 'there'} w{i}", "en") for i in range(300)] + [(7, "again", "en")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    blocks = toxicity._blocks(docs, known_labels(labels, "toxic", F.lit(False)), 300)
    got = blocks.agg(F.count("*"), F.sum(F.col("t0") + F.col("c0")), F.sum(F.col("t1") + F.col("c1"))).first()
    assert tuple(got) == (6, 200, 100)
    net = toxicity.ConvNet()
    toxicity._start(net, blocks, True, np.array([200, 100]))
    ids, _ = toxicity.word_parts(pa.array(["idiot"]))
    assert net.tables[0, ids[0, 0], 0] == pytest.approx(np.log((100.5 / 101) / (0.5 / 201)) * 100 / 105, rel=1e-5)
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs.where("text <> 'again'"), labels, "toxic", F.lit(False)).collect()}
    assert sum(scores[i] == int(i % 3 == 0) for i in range(300)) >= 295


def test_toxicity_blocks_are_small_rows_without_a_codec(spark):
    """Codecs and Arrow keep buffers of the largest page or row outside an executor's heap."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"word{x}ing" for x in rng.integers(0, 1000, 1000)), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    blocks = toxicity._blocks(docs, known_labels(labels, "toxic", F.lit(False)), 60)
    assert not any(c in f for f in blocks.inputFiles() for c in ("snappy", "zstd", "gzip"))
    (data,) = [r.data for r in blocks.collect()]
    # of a word, which of the distinct ones it is, not its four buckets
    assert len(data) < 3 * 60_000
    expected = sorted(toxicity.word_parts(pa.array([t]))[0].astype(np.int64).sum(0).tolist() for _, t, _ in rows)
    told = toxicity._over(blocks, lambda ids, offsets, y, fold, langs: (np.arange(len(y)), *np.add.reduceat(ids.astype(np.int64), offsets[:-1], axis=0).T), list("abcd"))
    assert sorted([r["a"], r["b"], r["c"], r["d"]] for r in told.to_pylist()) == expected


def test_a_pattern_is_sought_once_in_a_text(spark):
    """And what is found is the same, in texts with the mark that hits are set between, too."""
    some = ["", "ab", "1. a 2. b", "x1.1.", "\uffff1.\uffff2.", "题1.题\n2.", "1.", "$0 1. \\", None]
    found = find_all(F.col("t"), r"\d\.")
    rows = spark.createDataFrame(list(enumerate(some)), "i int, t string").select("i", found.alias("f"))
    for r in rows.collect():
        t = some[r.i]
        hits = list(re.finditer(r"\d\.", t or ""))
        ends = [*(h.start() for h in hits[1:]), len(t or "")]
        assert [tuple(x) for x in r.f or []] == [(h.start(), h[0], t[h.end() : e]) for h, e in zip(hits, ends, strict=bool(hits))]
    assert "regexp_replace" in rows._jdf.queryExecution().analyzed().toString()


def exchanges(df):
    """(shuffles, scans) of the plan before it is adapted."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text.count("FileScan")


def test_f9_rows_of_a_paper_are_made_once(spark):
    """the bar took a paper's whole nested row to be made three times, and tables were dealt out again for each step."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = registry.queries()["f9_paper"](spark, SF)
        assert view._jdf.queryExecution().executedPlan().toString().count("customer.parquet") == 1
        assert exchanges(answers(spark, SF).groupBy("sheet_id").count())[0] == 1
        lines = answers(spark, SF).select("sheet_id", (F.col("sheet_id") % 7).alias("p"), F.col("n").alias("id"), F.when(F.col("n") > 1, 1).alias("cont_of"), F.col("n").alias("ord"), F.lit("c").alias("caption"), F.lit("i").alias("image"), F.array(F.array(F.lit("x"))).alias("rows"))
        united = merge.united_tables(lines, ["p", "sheet_id"])
        assert exchanges(united) == (1, 1)
        assert {(r.id, r.n_parts) for r in united.collect()} == {(1, r.n) for r in answers(spark, SF).groupBy("sheet_id").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_united_tables_by_two_keys(spark):
    tables = spark.createDataFrame(
        [(1, 1, 1, None, 1, "a", "i", [["x"]]), (1, 1, 2, 1, 2, "b", "j", [["y"]]), (1, 1, 3, 1, 3, "c", "k", [["y", "z"]]), (2, 1, 1, None, 1, "d", None, [["u"]]), (2, 1, 2, 1, 2, "e", "", []), (2, 1, 4, 3, 4, "f", "l", [["v"]]), (1, 2, 2, 1, 2, "g", "m", [["w"]])],
        "paper_id int, n int, id int, cont_of int, ord int, caption string, image string, rows array<array<string>>",
    )
    got = {tuple(r) for r in merge.united_tables(tables, ["paper_id", "n"]).select("paper_id", "n", "id", "caption", F.to_json("rows"), F.array_join("images", ","), "n_parts").collect()}
    assert got == {(1, 1, 1, "a", '[["x"],["y"]]', "i,j", 2), (1, 1, 3, "c", '[["y","z"]]', "k", 1), (2, 1, 1, "d", '[["u"]]', "", 1), (2, 1, 2, "e", "[]", "", 1), (2, 1, 4, "f", '[["v"]]', "l", 1), (1, 2, 2, "g", '[["w"]]', "m", 1)}


def test_texts_are_composed_to_their_end(spark, tmp_path):
    """only the first 400 characters were."""
    texts = [None, "", "eq", "x" * 400 + "eqn tail", "x" * 400 + "eqn tale", "oqn " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_md5 for r in registry.queries()["t3_composed"](spark, str(tmp_path)).collect()}
    composed = [t and unicodedata.normalize("NFC", t.replace("n", "\u0301").replace("q", "\u0323")) for t in texts]
    assert got == {i: None if t is None else hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(composed)}
    assert "substr" not in registry.oracle_sql()["t3_composed"]


def test_anchors_are_found_in_one_pass_over_texts_dealt_once(spark):
    """patterns and folds ran within lambdas, and lines were dealt out and numbered anew for each use of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = registry.queries()["a11_detect"](spark, SF)
        assert exchanges(found) == (3, 2)
        assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_anchors_of_odd_texts(spark):
    kinds = "|".join(cuts.TYPE_WORDS)

    def plain(t):
        words = [m for m in re.finditer(f"(?:{kinds})", t) if not re.search("[、，]", t[max(0, m.start() - 3) : m.start()])]
        for m in words:
            yield "type words", m.start(), m.end(), m[0], None
            if p := re.match(r"\s*[（(](\d+)分[)）]", t[m.end() :], re.ASCII):
                yield "type words with points", m.start(), m.end() + p.end(), m[0], int(p[1]) if int(p[1]) < 1 << 31 else None
        numbers = []
        for m in re.finditer(r"(?:^|[ \t\n\x0b\f\r\u3000\xa0])(\d{1,2})\s*[.．、]", t, re.ASCII):
            if int(m[1]) == len(numbers) + 1:
                numbers.append(("arabic numbers", m.start(1), m.end(), None, None))
        yield from numbers if len(numbers) >= 2 else []

    odd = ["", "题", "选题单选题", "、单选题", "，ab单选题", "，abc单选题", "单选题单选题(3分)", "多选题 \n（0012分) 多选题(2147483647分）多选题（2147483648分）多选题(٣分)多选题\u3000(4分)", "a😀填空题（5分）😀\uffff填空题"]
    odd += ["1.2.3.", "1. 2. 3.", " 1.\u30002．\xa03、\u20034.", "1 .12. 2\t. 123. 3.", "x1. 1. 2.", "01. 2.", "1.\n\n2.\x1c3.", "2. 1. 2. 3. 2.", "٣. 1. 2.", "1 2.", "1. 1. 2"]
    docs = spark.createDataFrame([(i, t, len(t or ""), None) for i, t in enumerate([*odd, None])], "k int, text string, length int, declared int")
    got = {tuple(r) for r in cuts.text_anchors(docs, "k", 2).select("k", "scheme", "pos", "end", "type", "points").collect()}
    assert got == {(i, *a) for i, t in enumerate(odd) for a in plain(t)}


def test_flows_are_known_by_their_documents(spark):
    """A flow of no document counts for nothing, and one of a document without anchors has its length and number."""
    flow = [(k, i, 1, 60.0 + 12 * (i % 2), -10.0 * (i + (i // 2) * 3), 10.5, 50 * i, 50 * i + 9) for k in (1, 2, None) for i in range(20)]
    flow = spark.createDataFrame(flow, "k int, seq int, page int, x double, y double, size double, start int, end int")
    docs = spark.createDataFrame([(1, "nothing", 1000, 9), (3, "nor here", 8, None)], "k int, text string, length int, declared int")
    assert [tuple(r) for r in cuts.detect(docs, flow, "k").select("k", "scheme", "n", "confident", "why").collect()] == [(1, "typography 10.5/60", 9, True, None)]
