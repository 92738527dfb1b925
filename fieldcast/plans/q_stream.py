"""Streaming queries: run the stream to completion, return its result as a batch DataFrame."""

from __future__ import annotations

from fieldcast.plans.context import Ctx
from fieldcast.plans.oracle_views import with_views
from fieldcast.plans.q_model import FOLDED, Model
from fieldcast.plans.registry import query
from fieldcast.streaming import feedback_stream as FS


@query("stream_feedback_counts", oracle=with_views(["f_feedback"], [], """
SELECT indicator, count(*) AS total,
       CAST(sum(CASE WHEN was_helpful = 1 THEN 1 ELSE 0 END) AS BIGINT) AS helpful,
       CAST(sum(CASE WHEN was_helpful = 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_helpful
FROM f_feedback GROUP BY indicator"""))
def stream_feedback_counts(ctx: Ctx):
    """Feedback counts maintained by a stateful stream over the feedback log;
    equal to the batch A9 result once the log is consumed."""
    run = FS.new_run_dir(ctx.spark, "feedback-counts")
    src = FS.land_feedback(ctx.feedback, f"{run}/log")
    FS.feedback_counts_stream(ctx.spark, src, f"{run}/counts", f"{run}/_checkpoint")
    return ctx.spark.read.parquet(f"{run}/counts")


@query("stream_feedback_refit", oracle=FOLDED)
def stream_feedback_refit(ctx: Ctx):
    """Corrections folded into the count model batch by batch."""
    m = Model(ctx)
    run = FS.new_run_dir(ctx.spark, "feedback-refit")
    src = FS.land_feedback(ctx.feedback, f"{run}/log")
    FS.refit_stream(ctx.spark, src, f"{run}/out", f"{run}/_checkpoint", m.model, m.modelled)
    return FS.latest_model(ctx.spark, f"{run}/out", m.model)
