"""Grading of free-form answers, Column to Column: three outcomes, right, wrong and null for what cannot be told.

A wrong verdict where nothing can be told does more harm than none, so numbers need a known unit, letters keep their case,
and answers that are long or unlike in length are left to a reader.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let
from .unicode import normal_form, normal_forms

# fixed values: what does not count in words, and the units that may follow a number
PUNCTUATION = r"[\s。，、；：．,;:!？?（）()【】\[\]]+"
_ATOM = "(?:mol|MeV|keV|min|rad|kg|cm|mm|km|nm|ms|Hz|Pa|eV|°C|Ω|μm|μs|m|s|g|h|N|J|W|V|A|C|T|K|L|°|%)"
UNIT = rf"^{_ATOM}(?:\^?-?\d)?(?:[/·*]{_ATOM}(?:\^?-?\d)?)*$"
_DECIMAL = r"\d+(?:\.\d+)?"
#: sign, then mantissa and power of ten, mantissa and exponent, fraction, or decimal, then the tail
_NUMBER = rf"(?s)^\s*([-+])?\s*(?:({_DECIMAL})\s*[×xX*]\s*10\s*\^?\s*([-+]?\d+)|({_DECIMAL})\s*[eE]\s*([-+]?\d+)|({_DECIMAL})\s*/\s*({_DECIMAL})|({_DECIMAL}))\s*(.*)$"
#: answers longer than this, or so many times as long as the other, are not called wrong
LONG, RATIO = 40, 3


def compatible(text: Column) -> Column:
    """The form NFKC: wide letters, powers, ligatures and unit signs replaced, marks put together with their letters."""
    return normal_form(text, "NFKC")


def norm_text(text: Column) -> Column:
    """Compatibility forms replaced, upper case, without punctuation and white space; null is empty."""
    return _words(compatible(text))


def _words(t: Column) -> Column:
    """:func:`norm_text` of a text in the form NFKC."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(t, F.lit("")))), PUNCTUATION, "")


def as_choice(text: Column) -> Column:
    """T4: the distinct letters A to D in order, if there is nothing else."""
    t = norm_text(text)
    return F.when(t.rlike("^[ABCD]+$"), F.array_join(F.array_sort(F.array_distinct(F.split(t, ""))), ""))


def lead_number(text: Column) -> Column:
    """T5: struct<value, tail>: the number that a text begins with, read at once as a double, and what follows it; null
    without one and for a fraction of zero."""
    return let(F.trim(compatible(text)), _lead)


def _lead(t: Column) -> Column:
    part = lambda k: F.regexp_extract(t, _NUMBER, k)
    power = lambda a, b: F.concat(a, F.lit("e"), b).try_cast("double")
    size = (
        F.when(part(2) != "", power(part(2), part(3)))
        .when(part(4) != "", power(part(4), part(5)))
        .when(part(6) != "", F.try_divide(part(6).try_cast("double"), F.nullif(part(7).try_cast("double"), F.lit(0.0))))
        .otherwise(F.nullif(part(8), F.lit("")).try_cast("double"))
    )
    return F.when(size.isNotNull(), F.struct(F.when(part(1) == "-", -size).otherwise(size).alias("value"), F.trim(part(9)).alias("tail")))


def _unit(tail: Column) -> Column:
    """:func:`unit_of` of a tail in the form NFKC."""
    return F.regexp_replace(F.trim(F.coalesce(tail, F.lit(""))), PUNCTUATION, "")


def _known_unit(unit: Column) -> Column:
    return (unit == "") | unit.rlike(UNIT)


def unit_of(tail: Column) -> Column:
    """A tail without punctuation and spaces, case kept."""
    return _unit(compatible(tail))


def unit_ok(tail: Column) -> Column:
    """Whether a tail is a known unit, or nothing."""
    return _known_unit(unit_of(tail))


def as_number(text: Column) -> Column:
    """struct<value, unit> of a number with a known unit or none; null for anything else."""
    return let(lead_number(text), lambda n: F.when(n.isNotNull() & _known_unit(_unit(n["tail"])), F.struct(n["value"].alias("value"), _unit(n["tail"]).alias("unit"))))


def norm_expr(text: Column) -> Column:
    """A formula in one spelling, case kept: no dollar signs or spaces, text commands unwrapped, one way to write
    fractions, dots, crosses, powers and indices."""
    return _expression(normal_form(text, "NFC"))


def _expression(t: Column) -> Column:
    """:func:`norm_expr` of a text in the form NFC."""
    t = F.coalesce(t, F.lit(""))
    # fixed values: digits below and above the line
    for k in range(10):
        t = F.replace(F.replace(t, F.lit("₀₁₂₃₄₅₆₇₈₉"[k]), F.lit(f"_{k}")), F.lit("⁰¹²³⁴⁵⁶⁷⁸⁹"[k]), F.lit(f"^{k}"))
    t = F.regexp_replace(F.replace(t, F.lit("$"), F.lit("")), r"\\(?:text|mathrm|mathit|operatorname)\s*\{([^{}]*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\\[,;! ]", ""), r"\\[dt]frac", r"\\frac")
    t = F.replace(F.replace(t, F.lit("·"), F.lit("\\cdot")), F.lit("×"), F.lit("\\times"))
    t = F.regexp_replace(F.regexp_replace(t, r"\^\{([^{}])\}", r"^$1"), r"_\{([^{}])\}", "_$1")
    return F.regexp_replace(t, r"\s+", "")


def blanks(text: Column) -> Column:
    """The parts of an answer to several blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "/"), lambda x: F.trim(x)), lambda x: x != "")


def same_value(a: Column, b: Column) -> Column:
    """Equal within a millionth of the larger."""
    return (a == b) | (F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.abs(b), F.lit(1e-12)))


def wordy(text: Column) -> Column:
    """Has no ASCII letter, so it is words of another script or signs."""
    return ~F.coalesce(text, F.lit("")).rlike("[A-Za-z]")


def _verdict(verdict: str | None, why: str) -> Column:
    return F.struct(F.lit(verdict).cast("string").alias("verdict"), F.lit(why).alias("why"))


def _read(forms: Column) -> Column:
    """Everything that two answers are compared by, of struct<text, k, c>: a text and its forms NFKC and NFC."""
    words, number = _words(forms["k"]), _lead(F.trim(forms["k"]))
    return F.struct(
        words.alias("words"),
        F.when(words.rlike("^[ABCD]+$"), F.array_join(F.array_sort(F.array_distinct(F.split(words, ""))), "")).alias("choice"),
        number["value"].alias("value"),
        _unit(number["tail"]).alias("unit"),
        _expression(forms["c"]).alias("expr"),
        wordy(forms["text"]).alias("wordy"),
    )


def _compare(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    """One blank: choice letters, then numbers with units, then ``otherwise``, then formulas or words."""
    known = lambda x: _known_unit(x["unit"])
    out = F.when(a["choice"].isNotNull() & b["choice"].isNotNull(), F.when(a["choice"] == b["choice"], _verdict("right", "same letters")).otherwise(_verdict("wrong", "other letters")))
    out = out.when(
        a["value"].isNotNull() & b["value"].isNotNull() & (known(a) | known(b)),
        F.when(~same_value(a["value"], b["value"]), _verdict("wrong", "other number")).when(a["unit"] == b["unit"], _verdict("right", "same number and unit")).otherwise(_verdict(None, "same number, other unit")),
    )
    if otherwise is not None:
        out = out.when(otherwise.isNotNull(), otherwise)
    p, q = a["expr"], b["expr"]
    low, high = F.least(F.length(p), F.length(q)), F.greatest(F.length(p), F.length(q))
    return (
        out.when(p == q, _verdict("right", "same formula"))
        .when(a["wordy"] & b["wordy"] & (a["words"] == b["words"]), _verdict("right", "same words"))
        .when((high > LONG) | (high > RATIO * F.greatest(low, F.lit(1))), _verdict(None, "too unlike in form"))
        .otherwise(_verdict("wrong", "other formula or words"))
    )


def judge(student: Column, ref: Column) -> Column:
    """struct<verdict, why>: right, wrong, or null where it cannot be told, and the reason.

    Blanks are judged one by one; the first that is not right decides. A fraction of two numbers is a number, not two blanks.
    """
    none = F.lit(None).cast("struct<verdict:string,why:string>")
    # both answers, then the blanks of each; every one is read once
    pieces = F.concat(F.array(student, ref), blanks(student), blanks(ref))
    forms = F.arrays_zip(pieces.alias("text"), normal_forms(pieces, "NFKC").alias("k"), normal_forms(pieces, "NFC").alias("c"))
    n, m = F.size(blanks(student)), F.size(blanks(ref))

    def by_blank(reads: Column) -> Column:
        pairs = F.arrays_zip(F.slice(reads, F.lit(3), n).alias("x"), F.slice(reads, n + 3, m).alias("y"))
        each = F.transform(pairs, lambda p, i: F.struct((i + 1).alias("i"), _compare(p["x"], p["y"]).alias("v")))
        first = F.get(F.filter(each, lambda e: ~e["v"]["verdict"].eqNullSafe(F.lit("right"))), F.lit(0))
        told = F.when(first.isNotNull(), F.struct(first["v"]["verdict"].alias("verdict"), F.concat(F.lit("blank "), first["i"].cast("string"), F.lit(": "), first["v"]["why"]).alias("why")))
        return F.when((n < 2) & (m < 2), none).when(n != m, _verdict(None, "other number of blanks")).otherwise(F.coalesce(told, _verdict("right", "all blanks")))

    empty = (F.trim(F.coalesce(student, F.lit(""))) == "") | (F.trim(F.coalesce(ref, F.lit(""))) == "")
    judged = let(F.transform(forms, _read), lambda reads: _compare(reads[0], reads[1], by_blank(reads)))
    return F.when(empty, _verdict(None, "nothing on one side")).otherwise(judged)


def answers_agree(a: Column, b: Column) -> Column:
    """Whether two answers agree; null where it cannot be told."""
    return judge(a, b)["verdict"] == "right"


def verdict_of_score(got: Column, full: Column) -> Column:
    """Right, partial or wrong by points; null without a positive full score."""
    return F.when(got.isNull() | full.isNull() | (full <= 0), None).when(got >= full, "right").when(got <= 0, "wrong").otherwise("partial")


def decide(got: Column, full: Column, mark: Column, answer: Column) -> Column:
    """struct<verdict, by>: points beat marks (right, wrong, half); an answer alone never decides.

    ``blank`` needs an answer that was read as blank; what was not read at all is unsure.
    """
    scored, said = verdict_of_score(got, full), F.trim(F.coalesce(answer, F.lit("")))
    verdict = (
        F.when((scored == "wrong") & (said == "blank"), "blank")
        .when(scored.isNotNull(), scored)
        .when(mark.isin("right", "wrong"), mark)
        .when(mark == "half", "partial")
        .when(said == "blank", "blank")
        .otherwise("unsure")
    )
    return F.struct(verdict.alias("verdict"), F.when(scored.isNotNull(), "teacher_score").otherwise("teacher_mark").alias("by"))


def crosscheck(answer: Column, verdict: Column, red: Column, ref: Column) -> Column:
    """What contradicts the verdict: ``red`` where the teacher's own correction is not the reference, ``verdict`` where
    grading by the reference says otherwise; null where all agree or nothing can be told. A partial verdict contradicts nothing."""
    pen, said = F.trim(F.coalesce(red, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    graded = judge(said, ref)["verdict"]
    told = verdict.isin("right", "wrong") & ~said.isin("", "blank", "unreadable")
    return F.when(F.coalesce(ref, F.lit("")) == "", None).when((pen != "") & (judge(pen, ref)["verdict"] == "wrong"), "red").when(told & (graded != verdict), "verdict")
