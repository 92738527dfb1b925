"""Queries over the answer table: parsing, first answers, pivot, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.operators import answers as A
from fieldcast.operators import metadata as M
from fieldcast.plans.context import PROFILE_COLS, Ctx
from fieldcast.plans.oracle_views import with_views
from fieldcast.plans.registry import query
from fieldcast.plans.sql import A_LONG, FIRST, META_CTES, PCOLS

BASE = ["f_profiles", "f_answers"]


@query("json_props", oracle=with_views([], [], """
SELECT event_id, key, json_extract_string(props, concat('$.', key)) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) t
"""))
def json_props(ctx: Ctx):
    """P1 on a JSON text cell: one row per key of each event's ``props`` object."""
    e = ctx.table("events").select("event_id", "props")
    kv = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.explode(kv).alias("key", "value"))


@query("first_answer", oracle=with_views(BASE, [("a_long", A_LONG)], FIRST))
def first_answer(ctx: Ctx):
    """First answer per (profile, indicator); null first answers kept."""
    return ctx.first


_PIVOT_IDS = ["BH-1", "BH-2", "CM-5", "NM-4", "SM-5", "WI-6", "ZZ-7"]


@query("pivot_answers", oracle=with_views(BASE, [("a_long", A_LONG), ("first_ans", FIRST)], f"""
SELECT {PCOLS}, {", ".join(f"max(CASE WHEN indicator = '{i}' THEN answer END) AS \"{i}\"" for i in _PIVOT_IDS)}
FROM first_ans GROUP BY {PCOLS} HAVING count(answer) > 0
"""))
def pivot_answers(ctx: Ctx):
    """Wide table, one row per distinct profile and one column per indicator
    that holds any answer (the column list is a small distinct over indicators)."""
    ids = A.indicators_with_answers(ctx.answers)
    return A.pivot_answers(ctx.answers, ids)


@query("question_meta", oracle=with_views(BASE, [("a_long", A_LONG), *META_CTES], "SELECT * FROM meta"))
def question_meta(ctx: Ctx):
    """Question metadata derived from the answers."""
    return ctx.meta


@query("infer_type", oracle=with_views(BASE, [("a_long", A_LONG), *META_CTES], "SELECT * FROM infer"))
def infer_type(ctx: Ctx):
    """Question type and sorted options per indicator."""
    return M.infer_types(ctx.answers)


@query("section_for", oracle=with_views(BASE, [("a_long", A_LONG), *META_CTES[:1]], """
SELECT DISTINCT indicator, coalesce((SELECT s.section FROM sections s
       WHERE s.prefix = upper(regexp_replace(indicator, '[^\\p{L}]', '', 'g'))), 'General') AS section
FROM a_long
"""))
def section_for(ctx: Ctx):
    """Section of every indicator seen in the answers."""
    return M.with_section(ctx.answers.select("indicator").distinct(), ctx.spark)


@query("trainable_indicators", oracle=with_views(BASE, [("a_long", A_LONG), ("first_ans", FIRST)], """
SELECT indicator, count(answer) AS n_samples, count(DISTINCT answer) AS n_classes
FROM first_ans GROUP BY indicator
HAVING count(answer) >= 20 AND count(DISTINCT answer) > 1
"""))
def trainable_indicators(ctx: Ctx):
    """Indicators with at least 20 answered profiles and more than one class."""
    from fieldcast.operators.countmodel import trainable
    return trainable(ctx.first)
