"""Dimension, tolerance and datum text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.schemas import GDT_SYMBOLS

NUMBER = r"\d+\.?\d*"


def _num(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match as a double, spaces dropped; null without a match."""
    return F.regexp_replace(F.regexp_extract(text, pattern, group), " ", "").try_cast("double")


def dimension(text: Column) -> Column:
    """Struct `type, nominal, value, upper_limit, lower_limit, upper_deviation, lower_deviation` of a dimension label.

    After diameter and degree signs are dropped the text must begin with `n±t` (symmetric), `n[±u]/l` (asymmetric, the
    value half the span) or a number (nominal_only); else all is 0 and the type unknown. Null text: unknown.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[⌀°]", ""))
    sym = rf"^({NUMBER})\s*±\s*({NUMBER})"
    asym = rf"^({NUMBER})\s*([+-]\s*{NUMBER})?\s*/\s*([+-]?\s*{NUMBER})"
    plain = rf"^({NUMBER})"
    n, tol = _num(t, sym, 1), _num(t, sym, 2)
    an, up, low = _num(t, asym, 1), F.coalesce(_num(t, asym, 2), F.lit(0.0)), _num(t, asym, 3)
    p = _num(t, plain, 1)
    zero, none = F.lit(0.0), F.lit(None).cast("double")

    def row(kind, nominal, value, upper, lower, ud=none, ld=none):
        return F.struct(F.lit(kind).alias("type"), nominal.alias("nominal"), value.alias("value"), upper.alias("upper_limit"), lower.alias("lower_limit"), ud.alias("upper_deviation"), ld.alias("lower_deviation"))

    return (
        F.when(t.rlike(sym), row("symmetric", n, tol, n + tol, n - tol))
        .when(t.rlike(asym), row("asymmetric", an, F.abs(up - low) / 2, an + up, an + low, up, low))
        .when(t.rlike(plain), row("nominal_only", p, zero, p, p))
        .otherwise(row("unknown", zero, zero, zero, zero))
    )


def tolerance(text: Column, legacy: bool = False) -> Column:
    """Struct `type, nominal, value, upper_limit, lower_limit` found anywhere in a recognised text.

    `n±t` bilateral, `n+u/-l` limit, then a number: diameter if the text has a diameter sign or DIA, fit if a class
    such as H7 follows, else linear. `legacy` takes the number as the pattern that eats leading digits leaves it
    (`10` gives 0, `12.5` gives 2.5) and then knows no fits.
    """
    t = F.coalesce(text, F.lit(""))
    sym, lim, fit = rf"({NUMBER})\s*±\s*({NUMBER})", rf"({NUMBER})\s*\+\s*({NUMBER})\s*/\s*-\s*({NUMBER})", rf"({NUMBER})\s*([Hh][0-9]|[Gg][0-9])"
    any_ = rf"(?i)[⌀DIA\d]*\s*({NUMBER})" if legacy else rf"({NUMBER})"
    n, v = _num(t, sym, 1), _num(t, sym, 2)
    ln, lu, ll = _num(t, lim, 1), _num(t, lim, 2), _num(t, lim, 3)
    p = _num(t, any_, 1)
    zero = F.lit(0.0)
    round_ = t.contains("⌀") | F.upper(t).contains("DIA")
    kind = F.when(round_, "diameter").otherwise("linear") if legacy else F.when(t.rlike(fit), "fit").when(round_, "diameter").otherwise("linear")

    def row(k, nominal, value, upper, lower):
        return F.struct(k.alias("type"), nominal.alias("nominal"), value.alias("value"), upper.alias("upper_limit"), lower.alias("lower_limit"))

    return (
        F.when(t.rlike(sym), row(F.lit("bilateral"), n, v, n + v, n - v))
        .when(t.rlike(lim), row(F.lit("limit"), ln, F.lit(None).cast("double"), ln + lu, ln - ll))
        .when(p.isNotNull(), row(kind, p, zero, p, p))
        .otherwise(row(F.lit("unknown"), zero, zero, zero, zero))
    )


def cleaned(text: Column) -> Column:
    """White space collapsed, stray marks dropped, letters read as digits, `+/-` as `±`, trimmed."""
    t = F.translate(F.regexp_replace(text, r"\s+", " "), "oOlI?|!", "0011")
    return F.trim(F.replace(t, F.lit("+/-"), F.lit("±")))


def semantic_category(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(text.contains("⌀") | low.contains("dia"), "hole").when(text.contains("R") | low.contains("radius"), "fillet").when(text.contains("□") | low.contains("square"), "slot")
        .when(text.contains("⌖") | low.contains("position"), "pattern").when(text.contains("⟂") | low.contains("perpendicular"), "surface")
        .when(text.contains("⏊") | low.contains("flatness"), "plane").otherwise("unknown")
    )


def geometric_tolerance(text: Column) -> Column:
    """Kind of the first symbol, in the table's order, that the text holds."""
    out = F.lit(None).cast("string")
    for symbol, kind in reversed(GDT_SYMBOLS.items()):
        out = F.when(text.contains(symbol), F.lit(kind)).otherwise(out)
    return out


def label_category(text: Column) -> Column:
    return F.when(text.contains("⌀"), "hole").when(text.contains("±") | text.contains("/"), "dimension_with_tolerance").otherwise("dimension")


def allowed_kinds(category: Column, text: Column) -> Column:
    """Kinds of measured features that a label may describe, the first rule that holds."""
    kinds = lambda *k: F.array(*map(F.lit, k))
    cat, t = F.lower(F.coalesce(category, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(cat.contains("hole") | t.contains("⌀"), kinds("through_hole", "blind_hole", "cylinder", "sphere")).when(cat.contains("datum"), kinds("plane", "cylinder"))
        .when(cat.contains("width") | cat.contains("slot"), kinds("slot", "pocket")).when(cat.contains("chamfer") | t.contains("r"), kinds("chamfer", "fillet", "sphere", "cone"))
        .otherwise(kinds("plane", "pocket", "cylinder", "cone", "through_hole", "blind_hole"))
    )


def pair_kind(text: Column) -> Column:
    """Kind id of a label for pair vectors."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("⌀") | t.contains("diameter"), 2).when(t.contains("width") | t.contains("slot"), 4).otherwise(0)


def is_symbol_only(text: Column) -> Column:
    """A single character beyond U+2300, or only geometric symbols and spaces: no dimension."""
    return ((F.length(text) == 1) & (F.ascii(text) > 0x2300)) | text.rlike("^[" + "".join(GDT_SYMBOLS) + r"\s]+$")


def datum_letters(text: Column) -> Column:
    """Letters of a single or compound datum (`A`, `A B C`, `A-B-C`) in order; empty for any other text."""
    return F.when(text.rlike(r"^[A-Z](?:(?:\s+|\s*-\s*)[A-Z])*$"), F.regexp_extract_all(text, F.lit("([A-Z])"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def display(kind: Column, tol: Column) -> Column:
    v = F.format_string("%.2f", tol)
    return F.when(kind == "symmetric", F.concat(F.lit("±"), v)).when(kind == "upper", F.concat(F.lit("+"), v, F.lit("/0"))).otherwise(F.concat(F.lit("0/-"), v))


def tolerance_status(measured: Column, upper: Column, lower: Column) -> Column:
    """IN within the limits, MARGINAL up to a tenth of the range beyond one of them, else OUT; UNKNOWN without limits."""
    span = F.abs(upper - lower) * 0.1
    return (
        F.when(upper.isNull() | lower.isNull(), "UNKNOWN").when((measured >= lower) & (measured <= upper), "IN_TOLERANCE")
        .when((F.abs(measured - upper) <= span) | (F.abs(measured - lower) <= span), "MARGINAL").otherwise("OUT_OF_TOLERANCE")
    )


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def part_of(stem_: Column) -> Column:
    """Part id of a result file's stem: what stands before the view or cloud suffix and `_features`."""
    return F.regexp_replace(stem_, r"_(front|top|side|ideal|in_tol|out_tol)(_features)?$", "")


def first_kind(*candidates: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in candidates), F.lit("unknown"))
