"""License detection by ordered signature rules, with DataFrame functions alone.

The text is reduced to its words. Rules are regular expressions over the words, each behind a keyword; a document's
keywords are looked for first, and only the rules behind those found are tried. A detection is a span with a priority.
Detections are swept by start; one that lies within the span of another of the same or a better priority is dropped.
The sweep keeps, for each priority, how far detections of at least that priority reach, so it is linear in them.

Three base phrases are counted in every document by plain string functions, whatever the rules say.

Defined cases: null text is the empty text and gives no words, no labels and score 0; an empty table gives an empty
result; long texts are scanned whole; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, texts

#: words of a phrase: label
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: what is not a word: ASCII other than digits and lower-case letters, once A-Z are lower case
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: confidence of a detection by priority; a base phrase alone counts as the last
WEIGHTS = {1: 0.95, 2: 0.8, 3: 0.6}


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str


def _any(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


_V = r" (?:version |v ?|ver )?"
_LICENSE = r" (?:public )?licen[sc]e"


def _creative_commons() -> list[Rule]:
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
    made = []
    for kind, version in product(("by-nc-sa", "by-nc-nd", "by-sa", "by-nc", "by-nd", "by"), ("4.0", "3.0", "2.5", "2.0", "1.0", "")):
        number = " " + version.replace(".", " ") if version else ""
        label, priority = f"cc-{kind}" + (f"-{version}" if version else ""), 1 if version else 2
        made.append(Rule(priority, label, "cc", " cc " + kind.replace("-", " ") + number + " "))
        made.append(Rule(priority, label, "creative commons", " creative commons " + " ".join(parts[x] for x in kind.split("-")) + (f"(?: international| unported| generic)?(?: public licen[sc]e)?{number}" if version else "") + " "))
        if version:
            made.append(Rule(1, label, "creativecommons", f" creativecommons org licenses {kind.replace('-', ' ')}{number} "))
    return [*made, Rule(1, "cc0-1.0", "cc0", r" cc0(?: 1 0)?(?: universal)? "), Rule(1, "cc0-1.0", "creative commons", r" creative commons zero "), Rule(3, "cc", "creative commons", " creative commons ")]


def _gnu() -> list[Rule]:
    names = {"agpl": ("affero general public", "agpl"), "lgpl": ("(?:lesser|library) general public", "lgpl"), "gpl": ("general public", "gpl")}
    versions = {"agpl": ("1.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "gpl": ("1.0", "2.0", "3.0")}
    made = []
    for name, (long, short) in names.items():
        for version in versions[name]:
            major, minor = version.split(".")
            number = f"{major} {minor}" if minor != "0" else f"{major}(?: 0)?"
            for later, suffix in (("-or-later", r" (?:or (?:at your option )?(?:any )?(?:later|newer)|and later)"), ("-only", " only"), ("", "")):
                # the version may join the short name: gplv2, lgplv2.1, gpl3
                made.append(Rule(1, f"{name}-{version}{later}", f" {short}", f" (?:gnu )?{short}v?{number}{suffix} "))
                made.append(Rule(1, f"{name}-{version}{later}", "general public", f" (?:gnu )?{long} licen[sc]e{_V}{number}(?: of the licen[sc]e)?{suffix} "))
                made.append(Rule(1, f"{name}-{version}{later}", short, f" (?:gnu )?{short}{_V}{number}{suffix} "))
        made.append(Rule(2, name, "general public", f" (?:gnu )?{long} licen[sc]e "))
        made.append(Rule(3, name, short, f" (?:gnu )?{short} "))
    for version in ("1.1", "1.2", "1.3"):
        made.append(Rule(1, f"gfdl-{version}", "free documentation", f" (?:gnu )?free documentation licen[sc]e{_V}{version.replace('.', ' ')} "))
    return [*made, Rule(2, "gfdl", "free documentation", " (?:gnu )?free documentation licen[sc]e ")]


def _versioned() -> list[Rule]:
    """Families whose licences differ by version: label, keyword, pattern of the name, versions."""
    families = [
        ("apache", "apache", f" apache(?: software)?{_LICENSE}", ("1.0", "1.1", "2.0")),
        ("apache", "asl", " asl", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla", f" mozilla{_LICENSE}", ("1.0", "1.1", "2.0")),
        ("mpl", "mpl", " mpl", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", f" eclipse{_LICENSE}", ("1.0", "2.0")),
        ("epl", "epl", " epl", ("1.0", "2.0")),
        ("cddl", "common development", " common development and distribution licen[sc]e", ("1.0", "1.1")),
        ("cpl", "common public", " common public licen[sc]e", ("1.0",)),
        ("eupl", "european union", " european union public licen[sc]e", ("1.0", "1.1", "1.2")),
        ("eupl", "eupl", " eupl", ("1.0", "1.1", "1.2")),
        ("artistic", "artistic", " artistic licen[sc]e", ("1.0", "2.0")),
        ("ofl", "open font", " (?:sil )?open font licen[sc]e", ("1.0", "1.1")),
        ("afl", "academic free", " academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("osl", "open software", " open software licen[sc]e", ("1.0", "1.1", "2.0", "2.1", "3.0")),
        ("apsl", "apple public", " apple public source licen[sc]e", ("1.0", "1.1", "1.2", "2.0")),
        ("lppl", "latex project", " latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3")),
        ("zpl", "zope", " zope public licen[sc]e", ("1.1", "2.0", "2.1")),
        ("bsl", "boost", " boost software licen[sc]e", ("1.0",)),
        ("busl", "business source", " business source licen[sc]e", ("1.1",)),
        ("odbl", "open database", " open database licen[sc]e", ("1.0",)),
        ("odc-by", "open data commons", " open data commons attribution licen[sc]e", ("1.0",)),
        ("ms-pl", "microsoft public", " microsoft public licen[sc]e", ("1.0",)),
        ("cecill", "cecill", " cecill", ("1.0", "1.1", "2.0", "2.1")),
        ("php", "php licen", " php licen[sc]e", ("3.0", "3.01")),
        ("sspl", "server side public", " server side public licen[sc]e", ("1.0",)),
        ("upl", "universal permissive", " universal permissive licen[sc]e", ("1.0",)),
    ]
    made = []
    for label, keyword, name, versions in families:
        for version in versions:
            number = version.replace(".0", "(?: 0)?").replace(".", " ")
            made.append(Rule(1, f"{label}-{version}", keyword, f"(?:{name}){_V}{number} "))
            if name == f" {keyword}":
                made.append(Rule(1, f"{label}-{version}", f" {keyword}", f"{name}v?{number} "))
        if keyword != "asl":  # three letters that stand for much else
            made.append(Rule(2, label, keyword, f"(?:{name}) "))
    return made


def _plain() -> list[Rule]:
    bsd = [Rule(1, f"bsd-{n}-clause", "bsd", f" {_any(str(n), word)} clause bsd(?: licen[sc]e)? |" + f" bsd {_any(str(n), word)} clause(?: licen[sc]e)? ") for n, word in enumerate(("zero", "one", "two", "three", "four"))]
    bsd += [Rule(1, f"bsd-{n}-clause", "bsd", f" {word} bsd(?: licen[sc]e)? ") for n, word in ((2, "simplified"), (2, "free"), (3, "new"), (3, "modified"), (3, "revised"), (4, "original"), (4, "old"))]
    return [
        *bsd,
        Rule(2, "bsd", "bsd", " bsd(?: style)? licen[sc]e "),
        Rule(1, "bsd", "redistribution", " redistribution and use in source and binary forms "),
        Rule(1, "mit", "permission is hereby", " permission is hereby granted free of charge to any person obtaining a copy "),
        Rule(1, "mit", "mit licen", " (?:the )?mit licen[sc]e "),
        Rule(1, "mit", "expat", " (?:the )?expat licen[sc]e "),
        Rule(2, "mit", "under the mit", " (?:licen[sc]ed )?under the mit "),
        Rule(2, "mit", "under mit", " (?:licen[sc]ed )?under mit "),
        Rule(1, "isc", "permission to use", " permission to use copy modify and or distribute this software for any purpose "),
        Rule(1, "isc", "isc licen", " isc licen[sc]e "),
        Rule(1, "unlicense", "unlicense", " (?:the )?unlicense "),
        Rule(1, "unlicense", "unencumbered", " free and unencumbered software released into the public domain "),
        Rule(1, "wtfpl", "wtfpl", " wtfpl "),
        Rule(1, "zlib", "zlib", " zlib(?: libpng)? licen[sc]e "),
        Rule(1, "psf", "python software", " python software foundation licen[sc]e "),
        Rule(1, "openssl", "openssl", " openssl licen[sc]e "),
        Rule(1, "postgresql", "postgresql", " postgresql licen[sc]e "),
        Rule(1, "ncsa", "ncsa", " (?:university of illinois )?ncsa open source licen[sc]e "),
        Rule(1, "vim", "vim licen", " vim licen[sc]e "),
        Rule(1, "ruby", "ruby licen", " ruby licen[sc]e "),
        Rule(2, "public-domain", "public domain", " (?:in|into|to) the public domain "),
        Rule(3, "public-domain", "public domain", " public domain "),
        Rule(3, "copyright", "copyright", r" copyright(?: c)?(?: [0-9]{4})+ "),
        Rule(3, "proprietary", "proprietary", " proprietary (?:and confidential|licen[sc]e|software) "),
        Rule(3, "no-reuse", "permission", " (?:may not|must not) be (?:reproduced|copied|reused|distributed) without (?:prior )?(?:written )?permission "),
        Rule(3, "licensed", "licen", " licen[sc]ed under "),
    ]


def rules() -> list[Rule]:
    """All rules in order; of equal spans, the better priority and then the earlier rule wins."""
    return [*_creative_commons(), *_gnu(), *_versioned(), *_plain()]


def words(text: Column) -> Column:
    """The words of a text, each between two spaces of its own, as in ' a  b '; empty where there are none."""
    body = F.trim(F.regexp_replace(ascii_lower(text), NOT_WORD, "  "))
    return F.when(body == "", "").otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _needle(keyword: str) -> str:
    """A short keyword is a whole word, or the beginning of one if it has a space before it; a longer one may stand anywhere."""
    return keyword if keyword.startswith(" ") or len(keyword) >= 5 else f" {keyword} "


def _count(spaced: Column) -> Column:
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _detections(line: Column, found: list[Rule]) -> Column:
    """Spans of the rules whose keyword is there, as array<struct<s, e, p, k, label>>, by start and then longest."""
    by_keyword: dict[str, list[Column]] = {}
    for k, r in enumerate(found):
        rule = F.struct(F.lit(k).alias("k"), F.lit(r.priority).alias("p"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"))
        by_keyword.setdefault(_needle(r.keyword), []).append(rule)
    groups = F.array(*[F.struct(F.lit(w).alias("keyword"), F.array(*own).alias("rules")) for w, own in sorted(by_keyword.items())])

    def spans(r: Column) -> Column:
        hits = F.regexp_extract_all(line, r["pattern"], F.lit(0))
        gaps = F.transform(F.split(line, r["pattern"], -1), lambda x: F.length(x))
        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), F.transform(hits, lambda x: F.length(x)).alias("len"))
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), (start + x["len"]).alias("e")))).alias("out"))

        placed = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
        return F.transform(placed, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus_e"), r["p"].alias("p"), r["k"].alias("k"), r["label"].alias("label")))

    tried = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(line, g["keyword"])), lambda g: g["rules"]))
    return F.array_sort(F.flatten(F.transform(tried, spans)))


def _kept(detections: Column) -> Column:
    """struct<labels, best>: distinct labels and the best priority of what is not within another detection."""
    levels = sorted(WEIGHTS)
    zero = F.struct(*[F.lit(-1).alias(f"e{p}") for p in levels], F.expr("cast(array() as array<string>)").alias("labels"), F.lit(99).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_e"]
        reach = F.element_at(F.array(*[acc[f"e{p}"] for p in levels]), d["p"])
        out = end <= reach
        return F.struct(
            *[F.when(d["p"] <= p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in levels],
            F.when(out, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(out, acc["best"]).otherwise(F.least(acc["best"], d["p"])).alias("best"),
        )

    return F.aggregate(detections, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def license_scan(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per document, no shuffle."""
    found = rules() if found is None else found
    phrases = {" " + p.replace(" ", "  ") + " ": (len(p.split()), label) for p, label in BASE.items()}
    spaced = texts(docs).select("doc_id", words(F.col("text")).alias("w"))
    spaced = spaced.withColumn("n_words", _count(F.col("w")))
    count, first, last = [], [], []
    for p, (n, _) in phrases.items():
        cut = F.replace(F.col("w"), F.lit(p), F.lit(""))
        count.append(((F.octet_length("w") - F.octet_length(cut)) / len(p)).cast("long"))
        there = F.contains(F.col("w"), F.lit(p))
        first.append(F.when(there, _count(F.substring_index("w", p, 1))))
        last.append(F.when(there, F.col("n_words") - _count(F.substring_index("w", p, -1)) - n))
    # a chain of plain tests, not a lambda over the keywords, which would work out the line anew for each
    any_keyword = reduce(or_, [F.contains(F.col("line"), F.lit(k)) for k in sorted({_needle(r.keyword) for r in found})], F.lit(False))
    line = spaced.select(
        "doc_id", "n_words", sum(count[1:], count[0]).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(count, phrases.values(), strict=True)])).alias("base"),
        F.replace(F.col("w"), F.lit("  "), F.lit(" ")).alias("line"),
    )
    nothing = F.expr("named_struct('labels', cast(array() as array<string>), 'best', 99)")
    seen = line.withColumn("kept", F.when(any_keyword, _kept(_detections(F.col("line"), found))).otherwise(nothing))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    weight = F.lit(0.0)
    for p in sorted(WEIGHTS, reverse=True):
        weight = F.when(F.col("kept.best") <= p, WEIGHTS[p]).otherwise(weight)
    return seen.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "kept.labels")).alias("labels"),
        F.greatest(weight, F.when(F.col("n_base") > 0, WEIGHTS[3]).otherwise(0.0)).alias("score"),
    )
