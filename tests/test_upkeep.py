"""Commits, publishing, deletes, streams in order of time, assertions by case, normal forms, vocabularies and united tables."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from examlake.functions import grading as G
from examlake.functions import material
from examlake.functions import text as T
from examlake.functions.unicode import normal_form
from examlake.operators import assertions, merge, publishing, referential, state, vocabulary
from examlake.sources import commits
from examlake.streaming import ordered_quota

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_a_commit_is_all_tables_or_none(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert commits.head(spark, path) == 0 and commits.read(spark, path) == {} and commits.sweep(spark, path) == []
    assert commits.commit(spark, path, {"x": one, "y": one}, 0) == 1
    two = one.withColumn("v", F.lit("b"))
    assert commits.commit(spark, path, {"x": two}, 1) == 2
    assert rows(commits.read(spark, path)["x"]) == [(1, "b")] and rows(commits.read(spark, path)["y"]) == [(1, "a")] and rows(commits.read(spark, path, 1)["x"]) == [(1, "a")]
    # a second writer that began from version 1
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {"x": one.withColumn("v", F.lit("c")), "y": two}, 1)
    assert commits.versions(spark, path) == [1, 2] and rows(commits.read(spark, path)["x"]) == [(1, "b")] and len(commits.left_over(spark, path)) == 1
    # a writer that is killed before its manifest is in place
    with monkeypatch.context() as m:
        m.setattr(commits, "_put_in_place", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            commits.commit(spark, path, {"x": one.withColumn("v", F.lit("d"))}, 2)
    assert commits.head(spark, path) == 2 and rows(commits.read(spark, path)["x"]) == [(1, "b")]
    assert len(commits.sweep(spark, path)) == 2 and commits.left_over(spark, path) == []
    assert rows(commits.read(spark, path, 1)["x"]) == [(1, "a")] and commits.commit(spark, path, {"x": one}, 2) == 3


PAPERS = "name string, source_kind string, source string, n_questions long, owner_id int, created_at timestamp, updated_at timestamp, run_started_at timestamp"


def test_publishing_replaces_content_and_keeps_what_was_learned(spark, tmp_path):
    path, at = f"file://{tmp_path}/store", F.lit("2024-01-02").cast("timestamp")
    empty = {"papers": PAPERS, "questions": "name string, n int, stem string, label string", "options": "name string, n int, text string", "solutions": "name string, n int, answer string", "assets": "name string, rel_path string, sha256 string"}
    state_ = {name: spark.createDataFrame([], schema) for name, schema in empty.items()}
    state_["papers"] = spark.createDataFrame([("cards", "answers_only", None, 1, 5, None, None, None)], PAPERS)
    commits.commit(spark, path, state_, 0)
    new = lambda ns, text: {
        "papers": spark.createDataFrame([("p", f"{text}.pdf")], "name string, source string"),
        "questions": spark.createDataFrame([("p", n, f"{text} {n}") for n in ns], "name string, n int, stem string"),
        "options": spark.createDataFrame([("p", n, text) for n in ns], empty["options"]),
        "assets": spark.createDataFrame([("p", f"img/{n}", text) for n in ns], empty["assets"]),
    }
    publish = lambda what, owner: commits.publish(spark, path, what, ["stem"], at, F.lit(owner), ["options"], ["solutions"])
    assert publish(new([1, 2], "old"), 7) == 2
    learned = commits.read(spark, path)
    commits.commit(spark, path, {"questions": learned["questions"].withColumn("label", F.concat(F.lit("label "), F.col("n").cast("string"))), "solutions": spark.createDataFrame([("p", 1, "A"), ("p", 2, "B")], empty["solutions"])}, 2)
    assert publish(new([2, 3], "new"), 8) == 4
    now = commits.read(spark, path)
    assert rows(now["questions"]) == [("p", 2, "new 2", "label 2"), ("p", 3, "new 3", None)]
    assert rows(now["options"]) == [("p", 2, "new"), ("p", 3, "new")] and rows(now["solutions"]) == [("p", 2, "B")]
    assert rows(now["assets"]) == [("p", "img/1", "old"), ("p", "img/2", "new"), ("p", "img/3", "new")]
    assert rows(now["papers"], "name", "source", "n_questions", "owner_id") == [("cards", None, 1, 5), ("p", "new.pdf", 2, 7)]
    other = {**new([1], "x"), "papers": spark.createDataFrame([("cards", "x.pdf")], "name string, source string")}
    with pytest.raises(ValueError, match="cards"):
        publish(other, 9)
    assert commits.head(spark, path) == 4 and commits.left_over(spark, path) == []
    nothing = {k: v.limit(0) for k, v in new([1], "x").items()}
    assert publishing.next_state(now, nothing, ["stem"], at, F.lit(1), ["options"], ["solutions"])["questions"].count() == 2


def test_deletes_follow_a_chain_and_count_what_they_unbind(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "id int, a int"),
        "c": spark.createDataFrame([(100, 10), (101, 12), (102, 11), (102, 11)], "id int, b int"),
        "d": spark.createDataFrame([(1000, 100), (1001, 101)], "id int, c int"),
    }
    relations = [("b", ["a"], "a", ["id"], "cascade"), ("c", ["b"], "b", ["id"], "cascade"), ("d", ["c"], "c", ["id"], "set null")]
    doomed = spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int")
    after, changes = referential.delete_rows(tables, relations, "a", doomed, ["id"])
    assert {n: rows(t) for n, t in after.items()} == {"a": [(2,), (3,), (None,)], "b": [(12, 2), (13, None)], "c": [(101, 12)], "d": [(1000, None), (1001, 101)]}
    assert {k: v.count() for k, v in changes.items()} == {("a", "delete"): 1, ("b", "delete"): 2, ("c", "delete"): 3, ("d", "set null"): 1}
    assert tables["a"].count() == 4


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ordered_quota.ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_a_stream_out_of_order_and_restarted_decides_as_the_batch_does(spark, tmp_path, rocksdb):
    rng = random.Random(4)
    start = 1_700_000_000
    events = [(rng.randint(0, 3), i, start + rng.randint(0, 4000)) for i in range(300)]
    events.sort(key=lambda e: e[2] + rng.randint(0, 500))
    schema = "user long, id long, at timestamp"
    batch = lambda some: spark.createDataFrame(some, "user long, id long, t long").select("user", "id", F.timestamp_seconds("t").alias("at"))

    def run(parts):
        for k, part in parts:
            batch(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = ordered_quota.quota(source, "user", "at", "id", 600, 3, delay="10 minutes")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    run([("0", events[:120]), ("1", events[120:200])])
    first = spark.read.parquet(f"{tmp_path}/out").count()
    assert 0 < first < 200
    # again from the checkpoint; the last events move the watermark beyond all others, and one comes too late
    run([("2", events[200:])])
    run([("3", [(9, 900, start + 20000)])])
    run([("4", [(0, 901, start + 10), (9, 902, start + 40000)])])
    got = spark.read.parquet(f"{tmp_path}/out").where("user < 9")
    want = state.quota(batch(events), "user", F.unix_timestamp("at"), "id", 600, 3)
    assert rows(got, "user", "id", "allowed") == rows(want, "user", "id", "allowed")


def test_four_outcomes_of_assertions_and_more(spark):
    asked = spark.createDataFrame(
        [("s", "a", i, e, r, {"g": 9.8}) for i, (e, r) in enumerate([("all(diff(v) > 0)", None), ("v[-1] < g", "v[-1]"), ("v >", None), ("w > 0", None), ("v[99] > 0", None), (None, None), ("v[0] > 9", "w"), ("len(v) == 3", None)])]
        + [("s", "b", 8, "v > 0", None, None), ("s", None, 9, "v > 0", None, None), ("t", "a", 10, "v > 0", None, None), ("s", "a", 11, "isfinite(v)", None, None)],
        "spec string, case string, id int, expression string, report string, constants map<string,double>",
    )
    samples = spark.createDataFrame([("s", "a", "v", 2.0, 16.0), ("s", "a", "v", 0.0, 1.0), ("s", "a", "v", 1.0, 4.0), ("s", None, "v", 0.0, 1.0), ("u", "a", "v", 0.0, 1.0)], "spec string, case string, name string, at double, value double")
    got = {r.id: (r.outcome, r.name, r.found) for r in assertions.check(asked, samples).collect()}
    assert got == {
        0: ("true", None, None), 1: ("false", None, [16.0]), 2: ("error", None, None), 3: ("unknown name", "w", None), 4: ("error", None, None), 5: ("error", None, None), 6: ("false", None, []), 7: ("true", None, None),
        8: ("missing", None, None), 9: ("missing", None, None), 10: ("missing", None, None), 11: ("true", None, None),
    }
    gate = assertions.gate(asked, samples)
    assert rows(gate.where("spec = 't'"), "spec", "case", "id", "outcome") == [("t", None, None, "no series")] and gate.where("outcome = 'unknown name'").count() == 0
    assert rows(assertions.verdicts(gate)) == [("s", 3, 11, False), ("t", 0, 1, False)]
    assert assertions.check(asked.limit(0), samples).count() == 0
    nulls = spark.createDataFrame([("s", "a", "v", 0.0, 1.0), ("s", "a", "v", 1.0, None)], samples.schema)
    assert {r.id: r.outcome for r in assertions.check(asked, nulls).collect()}[11] == "false"


def test_normal_forms_of_every_code_point_and_of_random_sequences(spark):
    points = [(c, chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(5)
    special = [c for c, ch in points if c < 0x20000 and (unicodedata.combining(ch) or unicodedata.decomposition(ch) or unicodedata.normalize("NFKC", ch) != ch)]
    pools = [special, [*range(0x1100, 0x1200), *range(0xAC00, 0xAE00, 7)], list(range(0x300, 0x345)), list(map(ord, "aeiouAEcCnNdsS1/ ")), [0x9C7, 0x9BE, 0x9D7, 0xDD9, 0xDCF, 0xDCA, 0x110A5, 0x110BA, 0]]
    mixed = [(-i, "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 12)))) for i in range(1, 3000)]
    df = spark.createDataFrame([*points, *mixed, (-9999, None)], "i int, t string").repartition(8)
    for r in df.select("t", normal_form(F.col("t"), "NFKC").alias("k"), normal_form(F.col("t"), "NFC").alias("c")).collect():
        assert (r.k, r.c) == (None if r.t is None else unicodedata.normalize("NFKC", r.t), None if r.t is None else unicodedata.normalize("NFC", r.t)), r.t
    with pytest.raises(ValueError):
        normal_form(F.col("t"), "NFD")


def test_vocabulary(spark):
    entries = [(1, "a.b", "磁场", "one", '["x"]'), (2, "a.b", "磁场", "two", None), (3, " ", "光学", "", "[]"), (4, "A", "x", "n", '{"a": 1}'), (5, None, None, "n", "null"), (6, None, "热学", "n", '"x"')]
    got = rows(vocabulary.problems(spark.createDataFrame(entries, "i int, code string, chapter string, name string, aliases string"), "i"))
    assert got == sorted(
        [(2, "repeated", "a.b"), (3, "lacks", "code"), (3, "lacks", "name"), (3, "code", " "), (4, "code", "A"), (4, "chapter", "x"), (4, "aliases", '{"a": 1}'), (5, "lacks", "code"), (5, "lacks", "chapter"), (5, "chapter", None), (5, "aliases", "null"), (6, "lacks", "code"), (6, "repeated", None), (6, "aliases", '"x"')],
        key=repr,
    )
    index = vocabulary.index(spark.createDataFrame([("a", "c", " One ", '["ONE", "z"]'), ("b", "c", "one", None)], "code string, chapter string, name string, aliases string"))
    assert rows(index) == [("a", "a"), ("b", "b"), ("one", "a"), ("z", "a")]


def test_united_tables(spark):
    tables = spark.createDataFrame(
        [("q", 1, None, 1, "c", "i1", [["a", "b"]]), ("q", 3, 1, 3, "", "", [["e", "f"]]), ("q", 2, 1, 2, "", "i2", [["c", "d"]]), ("q", 4, 1, 4, "", "i4", [["x"]]), ("q", 5, 1, 5, "", None, []), ("q", 6, 99, 6, "z", None, None), ("r", 2, 1, 1, "w", "k", [["a"]])],
        "k string, id int, cont_of int, ord int, caption string, image string, rows array<array<string>>",
    )
    got = rows(merge.united_tables(tables, "k"), "k", "id", "rows", "images", "n_parts")
    assert got == sorted([("q", 1, [["a", "b"], ["c", "d"], ["e", "f"]], ["i1", "i2"], 3), ("q", 4, [["x"]], ["i4"], 1), ("q", 5, [], [], 1), ("q", 6, [], [], 1), ("r", 2, [["a"]], ["k"], 1)], key=repr)


def test_sessions_expire_and_are_touched(spark):
    day = lambda d: F.lit(d).cast("timestamp")
    sessions = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 9), ("", 1)], "token string, user_id int").withColumn("expires_at", F.when(F.col("token") == "b", day("2024-01-01")).otherwise(day("2024-03-01"))).withColumn("last_seen_at", F.lit(None).cast("timestamp"))
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("d",), ("x",), ("",), (None,)], "token string")
    told, after = state.session_users(asked, sessions, spark.createDataFrame([(1,), (2,)], "user_id int"), day("2024-02-01"))
    assert rows(told) == sorted([("a", "live", 1), ("b", "expired", None), ("d", "unknown", None), ("x", "unknown", None), ("", "unknown", None), (None, "unknown", None)], key=repr)
    assert {r.token: r.last_seen_at is not None for r in after.collect()} == {"a": True, "c": False, "d": False, "": False}


def test_matches_keep_their_place_whatever_the_text_holds(spark):
    rng = random.Random(7)
    import re

    texts = ["".join(rng.choice("ab1 2\x01x\n磁𝒙") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", None, "x\x01y R1 z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in (r"[a-z]\s?\d+", r"(?:^|\s)\d", r"b(?=a)"):
        for r in df.select("t", T.find_all(F.col("t"), pattern).alias("h")).collect():
            assert r.h is None if r.t is None else [(h.at, h.hit) for h in r.h] == [(m.start(), m[0]) for m in re.finditer(pattern, r.t)]


def test_material_of_a_question(spark):
    lit = F.lit
    none = lit(None).cast("string")
    steps = F.array(lit("one  two"), lit("three"))
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(material.for_topics(lit(False), lit(3), lit("计算题"), none, lit(" a\n b "), none, none, steps, lit("x"))) == "【第3题】计算题\n题干：a b\n解法：one two three"
    assert one(material.for_topics(lit(False), lit(3), none, none, none, none, none, F.array().cast("array<string>"), lit("y" * 300))) == "【第3题】\n题干：\n答案：" + "y" * 200
    assert one(material.for_topics(lit(True), lit(3), none, none, none, lit(" D "), none, lit(None).cast("array<string>"), none)) == "【第3题】\n标准答案：D"
    assert one(material.for_topics(lit(True), lit(3), none, none, none, none, none, lit(None).cast("array<string>"), none)) == "【第3题】\n（这道题只有题号，没有任何可判断的材料）"
    assert one(material.for_outline(lit(1), none, lit("$x$"), lit("x"), none)) == "【第1题】\n题干：$x$\n答案：（尚未解出）"
    assert one(material.for_pick(lit(1), none, none, lit(" a  b "), none, steps)) == "【第1题】\n题干： a b \n解法：one two / three"
    assert one(material.for_advice(lit(1203), lit("partial"), lit(1.5), lit(3.0), lit("B"), none, F.array(lit("磁场"), none, lit("")), none)) == "第 12(3) 题（**半对**，得 1.5 分、满分 3.0 分）\n  学生写的：B\n  标准答案：None\n  这道题考的：磁场"


def test_advice_that_says_nothing(spark):
    cases = {"粗心 v = 3": True, "": True, None: True, " \n": True, "对该知识点理解不到位": True, "选 B": False, "动能没有守恒": False, "v = 3": False, "think harder": True, "bad": False, "able": True}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.h for r in df.select("t", T.hollow(F.col("t")).alias("h")).collect()} == cases


#: student's answer, reference, verdict and reason
CASES = [
    ("a c", "AC", "right", "same letters"), ("AB", "AC", "wrong", "other letters"), ("db", "BD", "right", "same letters"), ("B、D", "bd", "right", "same letters"), ("BBD", "DB", "right", "same letters"),
    ("3.0 m/s", "3 m/s", "right", "same number and unit"), ("1.5e3", "1500", "right", "same number and unit"), ("2/4", "0.5", "right", "same number and unit"), ("4 kg", "4 g", None, "same number, other unit"),
    ("３．５ m", "3.5m", "right", "same number and unit"), ("3", "3 m", None, "same number, other unit"), ("3 foo", "3 m", None, "same number, other unit"), ("4 foo", "3 m", "wrong", "other number"),
    ("1.6×10^-19 C", "1.6e-19 C", "right", "same number and unit"), ("-2.5 m", "2.5 m", "wrong", "other number"), ("2×10^3 J", "2000 J", "right", "same number and unit"), ("9 °C", "9℃", "right", "same number and unit"),
    ("1.5 m/s", "1.5 米每秒", None, "same number, other unit"), ("", "A", None, "nothing on one side"), ("B", None, None, "nothing on one side"), ("  ", " ", None, "nothing on one side"),
    ("x^{2}+1", "x^2 + 1", "right", "same formula"), ("x²", "x^{2}", "right", "same formula"), ("v₀", "v_{0}", "right", "same formula"), (r"\dfrac{1}{2}mv^2", r"\frac{1}{2} m v^{2}", "right", "same formula"),
    (r"$h=5\ \text{cm}$", r"h = 5\,cm", "right", "same formula"), ("a·b", r"a\cdot b", "right", "same formula"), ("mgh", "mgH", "wrong", "other formula or words"), ("2mv", "2Mv", "wrong", "other formula or words"),
    ("Mm", "mm", "wrong", "other formula or words"), ("向左", "向右", "wrong", "other formula or words"), ("向左。", "向 左", "right", "same words"), ("x+1", "A", "wrong", "other formula or words"),
    ("ohm", "volt", "wrong", "other formula or words"), ("1 / 2 m / A", "1 / 2 m / A", "right", "same number and unit"), ("小于/等于/小于", "小于 / 等于 / 小于", "right", "all blanks"),
    ("小于/大于/小于", "小于 / 等于 / 小于", "wrong", "blank 2: other formula or words"), ("92 / 57", "92/56", "wrong", "other number"), ("小于/等于", "小于/等于/小于", None, "other number of blanks"),
    ("左 / 3", "左 / 3 m", None, "blank 2: same number, other unit"), ("the force points along the slope and grows with the angle", "it grows", None, "too unlike in form"), ("abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwy", "wrong", "other formula or words"),
    ("3/0", "3", None, "other number of blanks"),
]


def test_grading_of_cases(spark):
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _, _) in enumerate(CASES)], "i int, s string, r string")
    got = {r.i: (r.j.verdict, r.j.why) for r in df.select("i", G.judge(F.col("s"), F.col("r")).alias("j")).collect()}
    assert got == {i: (v, w) for i, (_, _, v, w) in enumerate(CASES)}
