"""Scalar column expressions used across the operators.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldcast import constants as C

__all__ = [
    "col_or_lit", "strip", "is_blank_answer", "clean_answer", "is_numeric_text", "is_boolean_text",
    "section_prefix", "coerce_number", "interaction", "category", "confidence_policy",
    "confidence_status", "question_policy", "question_policy_v1", "score_band", "score_band_color",
    "score_range", "flatten_value", "options_repr", "readable_feature", "helpful_flag",
    "version_label", "similarity_pct", "manual_reason", "yoy_direction", "review_group",
    "truthy", "irrigation_from_plan",
]


def col_or_lit(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def strip(a) -> Column:
    """Text without the white space (of any script) at its ends."""
    return F.regexp_replace(col_or_lit(a), C.STRIP, "")


def is_blank_answer(a) -> Column:
    """Null, '' or the texts 'null' / 'None' after trimming."""
    a = col_or_lit(a)
    return a.isNull() | strip(a).isin(*C.BLANK_ANSWERS)


def clean_answer(a) -> Column:
    """Trimmed answer, null when blank (the value type inference looks at)."""
    a = col_or_lit(a)
    return F.when(~is_blank_answer(a), strip(a))


def is_numeric_text(s) -> Column:
    """Digits with at most one '.' and at most one '-' (and at least one digit).

    Equal to removing one '.' and one '-' and testing that only digits remain.
    Written with length counts so the same rule runs in engines without look-ahead.
    """
    s = col_or_lit(s)
    dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    dashes = F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))
    return s.rlike(r"^[0-9.\-]+$") & s.rlike("[0-9]") & (dots <= 1) & (dashes <= 1)


def is_boolean_text(s) -> Column:
    return col_or_lit(s).isin(*C.BOOLEAN_ANSWERS)


def section_prefix(indicator) -> Column:
    """All letters of the id, upper-cased (BH-1 -> BH)."""
    return F.upper(F.regexp_replace(col_or_lit(indicator), r"[^\p{L}]", ""))


def coerce_number(x) -> Column:
    """X5: 'True' -> 1, 'False' -> 0, numeric text -> number, anything else -> 0."""
    x = col_or_lit(x)
    s = x.cast("string")
    return (F.when(s == "True", F.lit(1.0))
             .when(s == "False", F.lit(0.0))
             .otherwise(F.coalesce(s.try_cast("double"), F.lit(0.0))))


def interaction(a, b) -> Column:
    """X4: '<a>_<b>' with a missing side written as 'None' (H3)."""
    return F.concat_ws("_", F.coalesce(col_or_lit(a), F.lit("None")),
                       F.coalesce(col_or_lit(b), F.lit("None")))


def category(x) -> Column:
    """Category value as text with null -> 'Unknown' (H3 rule: at fit and apply)."""
    return F.coalesce(col_or_lit(x).cast("string"), F.lit(C.UNKNOWN))


def confidence_policy(conf) -> Column:
    """auto_fill (>=70) / suggest (>=40) / suggest_low."""
    c = col_or_lit(conf)
    return (F.when(c >= C.AUTO_FILL_THRESHOLD, "auto_fill")
             .when(c >= C.SUGGEST_THRESHOLD, "suggest").otherwise("suggest_low"))


def confidence_status(conf) -> Column:
    """Green / amber / red."""
    c = col_or_lit(conf)
    return (F.when(c >= C.AUTO_FILL_THRESHOLD, "green")
             .when(c >= C.SUGGEST_THRESHOLD, "amber").otherwise("red"))


def question_policy(q_type, conditional=None) -> Column:
    """X8 (v2): text/number -> manual, checkbox -> suggest, conditional -> suggest, else auto."""
    t = col_or_lit(q_type)
    cond = F.coalesce(col_or_lit(conditional), F.lit(False)) if conditional is not None else F.lit(False)
    return (F.when(t.isin("text", "number"), "manual")
             .when(t == "checkbox", "suggest")
             .when(cond, "suggest").otherwise("auto"))


def question_policy_v1(q_type, options, conditional=None) -> Column:
    """X9 (v1): text -> skip; checkbox, conditional, two-option radio -> suggest; else auto."""
    t = col_or_lit(q_type)
    cond = F.coalesce(col_or_lit(conditional), F.lit(False)) if conditional is not None else F.lit(False)
    n_opt = F.coalesce(F.size(col_or_lit(options)), F.lit(0))
    n_opt = F.when(col_or_lit(options).isNull(), 0).otherwise(n_opt)
    return (F.when(t == "text", "skip")
             .when(t == "checkbox", "suggest")
             .when(cond, "suggest")
             .when((t == "radio") & (n_opt == 2), "suggest").otherwise("auto"))


def score_band(score) -> Column:
    s = col_or_lit(score)
    expr = None
    for lower, band, _ in C.SCORE_BANDS:
        if lower is None:
            return expr.otherwise(band)
        expr = F.when(s >= lower, band) if expr is None else expr.when(s >= lower, band)
    return expr


def score_band_color(score) -> Column:
    s = col_or_lit(score)
    expr = None
    for lower, _, colour in C.SCORE_BANDS:
        if lower is None:
            return expr.otherwise(colour)
        expr = F.when(s >= lower, colour) if expr is None else expr.when(s >= lower, colour)
    return expr


def score_range(rounded_score) -> Column:
    """X12: 'lo–hi' with lo = max(0, s-7), hi = min(100, s+7), printed with no
    decimals, ties to even (as printf-style '%.0f' does on exact halves)."""
    s = col_or_lit(rounded_score)
    lo = F.greatest(F.lit(0.0), s - C.SCORE_RANGE_HALF_WIDTH)
    hi = F.least(F.lit(100.0), s + C.SCORE_RANGE_HALF_WIDTH)
    fmt = lambda v: F.bround(v, 0).cast("bigint").cast("string")
    return F.concat(fmt(lo), F.lit("–"), fmt(hi))


def flatten_value(value, options) -> Column:
    """Value if non-empty, else first suggested option, else ''."""
    return F.coalesce(F.nullif(col_or_lit(value), F.lit("")),
                      F.get(col_or_lit(options), 0), F.lit(""))


def options_repr(options) -> Column:
    """A list of strings printed the way the export writes it: ['a', 'b'].
    A text with an apostrophe and no quotation mark stands in quotation marks;
    else apostrophes, and always backslashes and line breaks, are escaped."""
    def quoted(x: Column) -> Column:
        t = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            t = F.replace(t, F.lit(char), F.lit(name))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), t, F.lit('"'))) \
                .otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(col_or_lit(options), quoted), ", "), F.lit("]"))


def readable_feature(name) -> Column:
    """X17: 'crop_country_encoded' -> 'Crop Country'."""
    n = F.replace(col_or_lit(name), F.lit("_encoded"), F.lit(""))
    return F.initcap(F.replace(n, F.lit("_"), F.lit(" ")))


def helpful_flag(b) -> Column:
    """True -> 1, false -> 0, else null."""
    b = col_or_lit(b)
    return F.when(b == F.lit(True), 1).when(b == F.lit(False), 0).cast("int")


def version_label(ts) -> Column:
    """v_YYYYMMDD_HHMMSS."""
    return F.date_format(col_or_lit(ts), "'v_'yyyyMMdd_HHmmss")


def similarity_pct(dist, max_dist) -> Column:
    """max(0, 1 - d/(dmax + 1e-9)) * 100 with dmax 0 -> 1."""
    d, m = col_or_lit(dist), col_or_lit(max_dist)
    m = F.when(m > 0, m).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), (1 - d / (m + F.lit(1e-9))) * 100)


def manual_reason(q_type) -> Column:
    """Reason text of a manual-entry row."""
    head, tail = C.MANUAL_REASON.split("{type}")
    return F.concat(F.lit(head), F.coalesce(col_or_lit(q_type), F.lit("text")), F.lit(tail))


def yoy_direction(curr_val, prev_val, curr_conf, prev_conf) -> Column:
    """Stable when the value is equal, else improved (higher confidence) or changed."""
    same = col_or_lit(curr_val).eqNullSafe(col_or_lit(prev_val))
    return (F.when(same, "stable")
             .when(col_or_lit(curr_conf) > col_or_lit(prev_conf), "improved").otherwise("changed"))


def review_group(ui_status) -> Column:
    """U4: green -> auto_filled, everything else -> needs_review."""
    return F.when(col_or_lit(ui_status) == "green", "auto_filled").otherwise("needs_review")


def truthy(x) -> Column:
    """Null for '' (text truthiness used by ``or`` fallbacks, H4)."""
    return F.nullif(col_or_lit(x), F.lit(""))


def irrigation_from_plan(x) -> Column:
    """P5: irrigated unless the type is rainfed / none / blank / missing."""
    x = col_or_lit(x)
    return (x.isNotNull() & ~x.isin("rainfed", "none", "")).cast("string").alias("irrigation")
