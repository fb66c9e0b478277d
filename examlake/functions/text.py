"""Text and number functions, Column to Column, without Python at run time. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Characters that T1 folds and what to: compatibility forms of CJK radicals, compatibility ideographs, wide space."""
    wide = [*range(0x2E80, 0x2EF4), *range(0x2F00, 0x2FD6), *range(0xF900, 0xFB00), 0x3000]
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in wide]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()
_CONTROL = "".join(map(chr, [*range(9), *range(11, 32)]))


def normalize(text: Column) -> Column:
    """Fold compatibility ideographs and the wide space, drop control characters other than tab and line feed."""
    return F.translate(F.translate(text, _FROM, _TO), _CONTROL, "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


#: a code point that no character has
_MARK = "\uffff"


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<at, hit, tail>>: every match of a pattern, which must not match nothing, where it begins, from 0, and what stands between it and the next."""
    none = F.lit([]).cast("array<struct<at:int,hit:string,tail:string>>")

    def step(acc: Column, x: Column) -> Column:
        found = F.array(F.struct(acc["at"].alias("at"), x["hit"].alias("hit"), x["tail"].alias("tail")))
        return F.struct((acc["at"] + F.length(x["hit"]) + F.length(x["tail"])).alias("at"), F.concat(acc["out"], found).alias("out"))

    def places(r: Column) -> Column:
        both = F.zip_with(r["hits"], F.slice(r["gaps"], 2, F.size(r["hits"])), lambda h, g: F.struct(h.alias("hit"), g.alias("tail")))
        begun = F.struct(F.length(r["gaps"][0]).alias("at"), none.alias("out"))
        return F.aggregate(both, begun, step, lambda acc: acc["out"])

    # the pattern is sought once: hits are set between marks, by which a text splits without a pattern; a text that has the mark is gone through twice
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    marked = lambda p: F.struct(F.filter(p, lambda _, i: i % 2 == 1).alias("hits"), F.filter(p, lambda _, i: i % 2 == 0).alias("gaps"))
    twice = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return let(F.when(text.contains(_MARK), twice).otherwise(let(parts, marked)), places)


_BETWEEN_CJK = r"(?<=[\u4e00-\u9fff])[ \u3000]+(?=[\u4e00-\u9fff])"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_stem(text: Column) -> Column:
    """Blanks and empty lines collapsed, no slash that stands on a line of its own, at the beginning or at the end, no
    space between ideographs; line ends stay."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{2,}", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?md)^\s*/\s*$", ""), _BETWEEN_CJK, "")
    return _strip(F.regexp_replace(F.regexp_replace(t, r"\s*/\s*$", ""), r"^\s*/\s*", ""))


# fixed values: what flattened formulas look like, and the functions whose arguments look alike
FLAT = r"[A-Za-zΩωπρμ]\s?\d{2,}|\]\d+|\d+[A-Za-z]{1,2}\d+"
_TRIG = r"^(sin|cos|tan|cot|sec|csc)\s?\d"


def text_quality(stem: Column, options: Column) -> Column:
    """struct<grade, reason>: whether a question's text can be used. ``options`` is array<struct<text, figure boolean>>.

    Options that are all figures are fine; four flattened formulas, or options without text, are ``degraded``; one flattened
    formula is ``suspect``.
    """
    texts = F.transform(options, lambda o: o["text"])
    empty = F.size(F.filter(texts, lambda t: F.trim(t) == ""))
    some, nearly = F.size(options) > 0, empty >= F.size(options) - 1
    grade = lambda g, why: F.struct(F.lit(g).alias("grade"), F.lit(why).alias("reason"))
    return let(
        F.regexp_count(F.concat(stem, F.lit(" "), F.array_join(texts, " ")), F.lit(FLAT)),
        lambda hits: F.when(some & F.forall(options, lambda o: F.coalesce(o["figure"], F.lit(False))) & nearly, grade("ok", "figures")).when(hits >= 4, grade("degraded", "flattened")).when(some & nearly, grade("degraded", "no option text")).when(hits > 0, grade("suspect", "indices lost")).otherwise(grade("ok", "")),
    )


def balanced(text: Column) -> Column:
    """Round brackets, narrow or wide, never close before they open, and all close."""
    marks = F.split(F.regexp_replace(F.translate(text, "（）", "()"), r"[^()]", ""), "")
    depth = F.aggregate(marks, F.lit(0), lambda acc, c: F.when(acc < 0, acc).otherwise(acc + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)))
    return depth == 0


def cjk_only(text: Column) -> Column:
    """CJK ideographs alone."""
    return F.regexp_replace(text, "[^\u4e00-\u9fff]", "")


def is_body(text: Column) -> Column:
    """Has an ideograph or an ASCII letter."""
    return text.rlike("[\u4e00-\u9fffA-Za-z]")


def question_number(text: Column) -> Column:
    """``12(1)`` is 1201 and ``11`` is 11; brackets may be wide; null for anything else."""
    t = F.translate(F.trim(text), "（）", "()")
    main, part = F.regexp_extract(t, r"^(\d{1,3})(?:\((\d{1,2})\))?$", 1), F.regexp_extract(t, r"^(\d{1,3})(?:\((\d{1,2})\))?$", 2)
    return F.when(main != "", F.when(part != "", main.try_cast("int") * 100 + part.try_cast("int")).otherwise(main.try_cast("int")))


def show_number(n: Column) -> Column:
    """1201 as ``12(1)``."""
    return F.when(n >= 100, F.concat((F.floor(n / 100)).cast("string"), F.lit("("), (n % 100).cast("string"), F.lit(")"))).otherwise(n.cast("string"))


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours, in words."""
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min "), (seconds % 60).cast("string"), F.lit(" s")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h "), F.floor(seconds % 3600 / 60).cast("string"), F.lit(" min")))
    )


def safe_name(name: Column) -> Column:
    """A file name of plain characters, at most 120."""
    return F.left(F.regexp_replace(F.regexp_replace(name, r"[^\w.-]+", "_"), r"^[_.]+", ""), F.lit(120))


def answer_key(text: Column) -> Column:
    """An answer for comparison, in lower case without spaces and dollar signs."""
    return F.lower(F.regexp_replace(text, r"[\s$]+", ""))


def source_hash(*parts: Column) -> Column:
    """A digest of all parts in order; null parts are empty."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def zone_start(text: Column, heading: str) -> Column:
    """Where the first line with a heading begins, from 0; -1 if there is none."""
    return F.regexp_instr(text, F.lit(heading)).cast("int") - 1


def split_answers(zone: Column, marker: str) -> Column:
    """(n, text) from each numbered marker to the next; none at all if the numbers do not rise strictly.

    ``marker`` has one group, the number. White space within answers is collapsed.
    """
    numbers = F.transform(F.regexp_extract_all(zone, F.lit(marker), F.lit(1)), lambda x: x.try_cast("int"))
    texts = F.slice(F.split(zone, marker, -1), 2, F.size(numbers))
    pairs = F.zip_with(numbers, texts, lambda n, t: F.struct(n.alias("n"), F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text")))
    rising = F.aggregate(numbers, F.lit(0), lambda acc, x: F.when((acc < 0) | (x <= acc), F.lit(-1)).otherwise(x)) >= 0
    return F.when(rising, pairs)


# fixed values: how options are marked, the surest first
_OPTION_MARKS = (r"(?:^|[\s\u3000\u00a0])([ABCD])\s*[.．]\s*", r"([ABCD])\s*[.．]\s*", r"(?:^|[\s\u3000\u00a0])([ABCD])\s*[、]\s*", r"([ABCD])\s*[.．、]\s*")


def _four_marks(stem: Column, marker: str) -> Column:
    """array<struct<at, end, key>> of the first four marks in a row that are A to D in any order; null without them."""
    marks = F.transform(find_all(stem, marker), lambda h: F.struct(h["at"].alias("at"), (h["at"] + F.length(h["hit"])).alias("end"), F.regexp_extract(h["hit"], marker, 1).alias("key")))

    def four(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(m) - 3, F.lit(1))), lambda i: F.array_join(F.array_sort(F.transform(F.slice(m, i, F.lit(4)), lambda x: x["key"])), "") == "ABCD")
        return F.when(F.size(starts) > 0, F.slice(m, F.get(starts, F.lit(0)), F.lit(4)))

    return let(marks, four)


def split_options(stem: Column) -> Column:
    """struct<body, options> with the texts of options A to D in order, whatever order they stand in; the stem alone, as
    it is, where four marks in a row cannot be found."""

    def cut(text: Column, four: Column) -> Column:
        bounds = F.transform(four, lambda m, i: F.struct(m["key"].alias("key"), m["end"].alias("from"), F.coalesce(F.get(four, i + 1)["at"], F.length(text)).alias("to")))
        clean = lambda t: F.regexp_replace(_strip(F.regexp_replace(_strip(t), r"\s*/\s*$", "")), _BETWEEN_CJK, "")
        texts = F.transform(F.array_sort(bounds), lambda b: clean(F.substring(text, b["from"] + 1, b["to"] - b["from"])))
        return F.struct(_strip(F.substring(text, F.lit(1), F.get(four, F.lit(0))["at"])).alias("body"), texts.alias("options"))

    def chosen(text: Column) -> Column:
        four = F.coalesce(*[_four_marks(text, m) for m in _OPTION_MARKS])
        whole = F.struct(text.alias("body"), F.lit([]).cast("array<string>").alias("options"))
        return let(four, lambda f: F.when(f.isNotNull(), cut(text, f)).otherwise(whole))

    return let(stem, chosen)


def coverage_note(source: Column, read: Column, blocks: Column | None = None) -> Column:
    """What a reading lacks of its source, by ideographs alone: ``blocks`` if one of its blocks has under 80 % of its source's
    length, ``short`` under 85 % in all, ``different`` under 75 % of the source's different ideographs; null if it will do.

    ``blocks`` is array<struct<source int, read int>> of lengths.
    """
    a, b = cjk_only(source), cjk_only(read)
    some, those = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")), F.split(b, "")
    share = F.size(F.array_intersect(some, those)) / F.greatest(F.size(some), F.lit(1))
    lacking = F.lit(False) if blocks is None else F.coalesce(F.exists(blocks, lambda x: (x["source"] > 0) & (x["read"] < 0.8 * x["source"])), F.lit(False))
    return F.when(lacking, "blocks").when(F.length(b) < 0.85 * F.greatest(F.length(a), F.lit(1)), "short").when(share < 0.75, "different")


def first_object(text: Column, schema: str) -> Column:
    """The first JSON object in a text, with stray backslashes taken as themselves."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.from_json(F.regexp_replace(block, r'\\(?![\\"/bfnrtu])', r"\\\\"), schema)


def norm_tex(text: Column) -> Column:
    """Bracketed formulas as dollar signs."""
    return F.regexp_replace(text, r"\\[()\[\]]", r"\$")


def tex_spans(text: Column) -> Column:
    """The formulas between dollar signs."""
    return F.regexp_extract_all(text, F.lit(r"\$[^$]+\$"), F.lit(0))


# fixed values: what names something concrete, and words that only blame
CONCRETE = (
    r"[A-Da-d](?![a-z])|\d|[=＝×÷/^_√∝Δ]"
    r"|定律|定理|公式|方程|守恒|左手|右手|安培|洛伦兹|动能|动量|电动势"
    r"|磁通|磁感|折射|干涉|衍射|半衰期|能级|谐振|欧姆|焦耳|楞次|法拉第"
    r"|正负|方向|单位|量级|符号|下标|分母|分子|矢量|标量|受力|分解"
)
BLAME = "粗心|马虎|不认真|没审题|审题不清"
PAGES, PAGE = r"共\s*(\d+)\s*页", r"第\s*(\d+)\s*页\s*(?:读到|✗)"


def hollow(text: Column) -> Column:
    """Advice that is empty, blames, or names nothing concrete: an option, a number, a formula, a term."""
    said = F.coalesce(text, F.lit(""))
    return (F.regexp_replace(said, r"(?U)\s+", "") == "") | said.rlike(BLAME) | ~said.rlike(CONCRETE)


def page_progress(line: Column) -> Column:
    """struct<done, total> of a log line: the page it says was read, and of how many; null where it says neither."""
    number = lambda p: F.regexp_extract(line, p, 1).try_cast("int")
    return F.struct(number(PAGE).alias("done"), number(PAGES).alias("total"))


def progress_of(line: Column) -> Column:
    """struct<done, total> of a log line such as ``page 3/12``."""
    part = lambda k: F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", k).try_cast("int")
    return F.when(part(2).isNotNull(), F.struct(part(1).alias("done"), part(2).alias("total")))


def payload(parts: list[tuple[Column, int]]) -> Column:
    """Parts, each cut to a length, on lines of their own; empty ones are left out."""
    return F.concat_ws("\n", *[F.nullif(F.left(F.coalesce(c, F.lit("")), F.lit(n)), F.lit("")) for c, n in parts])


def file_sections(text: Column) -> Column:
    """Map of file name to content of a text with ``===FILE name===`` lines; fences are stripped, other names dropped."""
    names = F.regexp_extract_all(text, F.lit(r"===FILE ([\w.-]+)==="), F.lit(1))
    bodies = F.transform(F.slice(F.split(text, r"===FILE [\w.-]+===", -1), F.lit(2), F.size(names)), lambda b: F.regexp_replace(F.regexp_replace(b, r"(?m)^```\w*\s*$", ""), r"^\s+|\s+$", ""))
    return F.map_from_entries(F.filter(F.arrays_zip(names.alias("key"), bodies.alias("value")), lambda e: e["key"].rlike(r"\.(js|css|html|json)$")))


def failure_phrase(text: Column, phrases: list[str]) -> Column:
    """The first known phrase that a text contains, whatever its case."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(p.lower())), F.lit(p)) for p in phrases])


def splice(text: Column, segments: Column) -> Column:
    """A text with [s, e) replaced by given strings, in order; a segment that overlaps an earlier one is left out.

    ``segments`` is array<struct<s int, e int, r string>>.
    """

    def step(acc: Column, x: Column) -> Column:
        ok = x["s"] >= acc["at"]
        return F.struct(F.when(ok, x["e"]).otherwise(acc["at"]).alias("at"), F.when(ok, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["r"])).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(segments), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def flat_hits(text: Column) -> Column:
    """How many flattened formulas a text has, those left out that are a function and its argument."""
    trig = lambda h: F.substring(text, F.greatest(h["at"] - 1, F.lit(1)), F.lit(6)).rlike(_TRIG)
    return F.size(F.filter(find_all(text, FLAT), lambda h: ~trig(h)))


def width(text: Column, size: Column) -> Column:
    """An estimate of a text's width: ideographs one size, others half of it."""
    wide = F.length(cjk_only(text))
    return (wide + (F.length(text) - wide) * 0.5) * size


def x_overlap(a0: Column, a1: Column, x0: Column, x1: Column, need: float = 0.6) -> Column:
    """Whether [x0, x1] covers so much of [a0, a1]."""
    return F.greatest(F.least(a1, x1) - F.greatest(a0, x0), F.lit(0.0)) >= need * (a1 - a0)


def near(y: Column, rule: Column, body: Column, k: float = 3.0) -> Column:
    """Within so many body sizes of a rule."""
    return F.abs(y - rule) <= k * body


def restore_backslashes(text: Column) -> Column:
    """Commands whose backslash and first letter were read as an escape: tab, line feed, form feed, bell and return."""
    for lost, kept in (("\t", r"\t"), ("\f", r"\f"), ("\b", r"\b"), ("\r", r"\r"), ("\x07", r"\a")):
        text = F.replace(text, F.lit(lost), F.lit(kept))
    return text


def question_text(stem: Column, options: Column) -> Column:
    """The stem and its options on lines of their own, lettered."""
    lettered = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat_ws("\n", stem, F.array_join(lettered, "\n"))


def any_question_number(text: Column) -> Column:
    """As :func:`question_number`, with any number of digits before the part."""
    t = F.translate(F.trim(text), "（）", "()")
    main, part = (F.regexp_extract(t, r"^(\d+)(?:\((\d+)\))?$", k) for k in (1, 2))
    return F.when(main != "", F.when(part != "", main.try_cast("long") * 100 + part.try_cast("long")).otherwise(main.try_cast("long")))


def answer_zone(text: Column, heading: str, marker: str) -> Column:
    """The numbered answers of the zone under a heading; null without one."""
    start = zone_start(text, heading)
    return F.when(start >= 0, split_answers(F.substring(text, start + 1, F.length(text)), marker))


def norm_email(text: Column) -> Column:
    """An address for comparison."""
    return F.lower(F.trim(text))


def type_words(text: Column, words: list[str]) -> Column:
    """How often type words head something, not those in a list, which follow a comma within three characters."""
    pattern = "|".join(words)
    pieces = F.split(text, pattern, -1)
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.size(F.filter(before, lambda x: ~x.rlike(r"[,、，]\s{0,2}$")))


def label_prefix(text: Column, most: int = 6) -> Column:
    """A label's beginning, up to punctuation and a length."""
    return F.left(F.regexp_extract(text, r"^([^,.;:(（，。；：]*)", 1), F.lit(most))


def qualify(expression: Column, keys: list[str], cases: list[str], prefix: str = "s.") -> Column:
    """Known keys of an expression with a prefix, unless they are case names or have one."""
    for k in sorted(set(keys) - set(cases)):
        expression = F.regexp_replace(expression, rf"(?<![\w.]){k}(?!\w)", prefix + k)
    return expression


def valid_name(text: Column) -> Column:
    """A name that is safe in a path."""
    return text.rlike(r"^[\w一-鿿][\w一-鿿 .()-]{0,79}$") & ~F.contains(text, F.lit(".."))


def cut_reason(share: Column, contrast: Column) -> Column:
    """Why a page is not cut at its bright band: too narrow, too faint or nearly all of it; null if it is."""
    return F.when(share < 0.10, "narrow").when(contrast < 60, "faint").when(share >= 0.60, "wide")


def valid_answer(value: Column, domain: list[str]) -> Column:
    """A value of a domain, or nothing; anything else raises an error when it is read."""
    return F.when(value.isNull() | value.isin(domain), value).otherwise(F.raise_error(F.concat(F.lit("not in the domain: "), value)))


def page_path(path: Column, name: Column, n: Column) -> Column:
    """Whether a path is that of page ``n`` of a name, leading zeros allowed, with any ending of letters."""
    found = lambda k: F.regexp_extract(path, r"^(.*)/p-0*(\d+)\.[a-z]+$", k)
    return (found(1) == name) & (found(2).try_cast("long") == n)
