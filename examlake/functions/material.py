"""What is known about a question, put into words for a reader, column by column.

Each function gives the text of one question; :func:`together` puts a paper's questions one after another. White space is folded before a part is cut to its length. Null and
empty parts are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: headings and remarks, as readers of these texts know them
HEAD, KIND_HEAD, STEM, REF_ANSWER, REF_SOLUTION, SOLUTION, ANSWER = "【第", "题】", "题干：", "标准答案：", "官方解答：", "解法：", "答案："
NOTHING, UNSOLVED, NO_ANSWER = "（这道题只有题号，没有任何可判断的材料）", "解法：（尚未解出，只能看题干判断）", "答案：（尚未解出）"
WRITTEN, TOPICS, PARTIAL = "\n  学生写的：", "\n  这道题考的：", "（**半对**，得 %s 分、满分 %s 分）"
NUMBER, KIND, FULL_STEM, TABLE, OPTIONS, GIVEN = "【题号】", "【题型】", "【题干】\n", "【表", "【选项】\n", "【阶段③ 给出的答案】\n"
STEPS, FACTS, ASSUMED, SURE = "【解题步骤】\n", "【可检验事实】（断言应当钉住这些）\n", "【解题时自补的假设】（题面没给，断言若依赖它们必须在 free_parameters 里说明）\n", "【解题置信度】"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _either(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))


def _folded(c: Column, most: int) -> Column:
    return F.left(F.regexp_replace(_text(c), r"(?U)\s+", " "), F.lit(most))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def _after(label: str, value: Column) -> Column:
    """A labelled part, null if there is nothing to it."""
    return F.when(value != "", F.concat(F.lit(label), value))


def _head(n: Column, kind: Column) -> Column:
    return F.concat(F.lit(HEAD), n.cast("string"), F.lit(KIND_HEAD), _text(kind))


def for_topics(sheet: Column, n: Column, kind: Column, stem_latex: Column, stem: Column, ref_answer: Column, ref_solution: Column, steps: Column, answer: Column) -> Column:
    """For naming the topics of a question: its stem, then what was solved, or on ``sheet`` papers the reference."""
    asked = _folded(_trimmed(_either(stem_latex, stem)), 260)
    known, official = _folded(_trimmed(ref_answer), 200), _folded(_trimmed(ref_solution), 400)
    solved = F.coalesce(_after(SOLUTION, _folded(F.array_join(steps, " "), 400)), _after(ANSWER, _folded(answer, 200)), F.lit(UNSOLVED))
    of_sheet = F.concat_ws("\n", _head(n, kind), _after(STEM, asked), _after(REF_ANSWER, known), _after(REF_SOLUTION, official), F.when((asked == "") & (known == "") & (official == ""), NOTHING))
    return F.when(sheet, of_sheet).otherwise(F.concat_ws("\n", _head(n, kind), F.concat(F.lit(STEM), asked), solved))


def for_outline(n: Column, kind: Column, stem_latex: Column, stem: Column, answer: Column) -> Column:
    """For a short title of a question."""
    return F.concat_ws("\n", _head(n, kind), F.concat(F.lit(STEM), _folded(_trimmed(_either(stem_latex, stem)), 220)), F.coalesce(_after(ANSWER, _folded(answer, 260)), F.lit(NO_ANSWER)))


def for_pick(n: Column, kind: Column, stem_latex: Column, stem: Column, answer: Column, steps: Column) -> Column:
    """For telling whether a question is worth a scene; ends are not trimmed."""
    return F.concat_ws("\n", _head(n, kind), F.concat(F.lit(STEM), _folded(_either(stem_latex, stem), 300)), _after(ANSWER, _folded(answer, 200)), _after(SOLUTION, _folded(F.array_join(steps, " / "), 260)))


def for_advice(n: Column, verdict: Column, got: Column, full: Column, answer: Column, ref_answer: Column, topics: Column, ref_solution: Column) -> Column:
    """For advice on an answer that lost points. What is not known reads ``None``."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    number = F.when(n >= 100, F.format_string("第 %d(%d) 题", F.floor(n / 100).cast("int"), (n % 100).cast("int"))).otherwise(F.format_string("第 %d 题", n.cast("int")))
    half = F.when(verdict == "partial", F.format_string(PARTIAL, said(got), said(full)))
    named = F.array_join(F.filter(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != ""), "、")
    return F.concat(number, _text(half), F.lit(WRITTEN), said(answer), F.lit("\n  " + REF_ANSWER), said(ref_answer), _text(_after(TOPICS, named)), _text(_after("\n  " + REF_SOLUTION, F.left(_text(ref_solution), F.lit(600)))))


def for_spec(n: Column, kind: Column, stem_latex: Column, stem: Column, tables: Column, options: Column, answer: Column, steps: Column, facts: Column, assumptions: Column, confidence: Column) -> Column:
    """For writing a specification: everything, uncut. ``tables`` is array<struct<id, rows array<array<string>>>>, ``options``
    array<struct<key, latex, text>>; tables without rows are left out."""
    listed = lambda items: F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), _text(s))), "\n")
    framed = F.transform(F.filter(tables, lambda t: F.size(t["rows"]) > 0), lambda t: F.concat(F.lit(TABLE), t["id"].cast("string"), F.lit("】\n"), F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, " | ")), "\n")))
    chosen = F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), _either(o["latex"], o["text"]))), "\n")
    parts = [
        F.concat(F.lit(NUMBER), n.cast("string")), F.concat(F.lit(KIND), _text(kind)), F.concat(F.lit(FULL_STEM), _either(stem_latex, stem)), F.when(F.size(framed) > 0, F.array_join(framed, "\n\n")), F.when(F.size(options) > 0, F.concat(F.lit(OPTIONS), chosen)),
        F.concat(F.lit(GIVEN), _text(answer)), F.concat(F.lit(STEPS), _text(listed(steps))), F.concat(F.lit(FACTS), _text(listed(facts))), F.when(F.size(assumptions) > 0, F.concat(F.lit(ASSUMED), listed(assumptions))), F.concat(F.lit(SURE), _either(confidence, F.lit("?"))),
    ]
    return F.concat_ws("\n\n", *parts)


def together(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """The texts of a paper's questions, in order, with an empty line between."""
    each = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(by).agg(F.array_join(F.transform(each, lambda x: x[text]), "\n\n").alias("material"))
