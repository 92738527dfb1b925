"""Lazily built domain DataFrames over one scale-factor folder.

Nothing here runs a job: every attribute is a DataFrame plan.  Each
registered query builds a fresh context, so plans never share state.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from fieldcast import constants as C
from fieldcast.operators import answers as A
from fieldcast.operators import metadata as M
from fieldcast.sources import fixtures as FX


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str, synonyms: DataFrame | None = None):
        """``synonyms``: the user's own crop table (S6) in place of the built-in one."""
        self.spark = spark
        self.sf_dir = sf_dir
        self.synonyms = synonyms

    @cached_property
    def profiles(self) -> DataFrame:
        return FX.profiles(self.spark, self.sf_dir)

    @cached_property
    def raw_answers(self) -> DataFrame:
        return FX.raw_answers(self.spark, self.sf_dir)

    @cached_property
    def answers(self) -> DataFrame:
        return A.answers_long(self.raw_answers, self.profiles)

    def share_answers(self) -> "Ctx":
        """Write the long answer table once (D3) so that every plan built from
        this context — metadata, first answers, training rows — reads it
        instead of re-running the window and the profile join."""
        from fieldcast.operators.util import materialize
        if "answers" not in self.__dict__ or not getattr(self, "_answers_shared", False):
            self.__dict__["answers"] = materialize(A.answers_long(self.raw_answers, self.profiles), "answers")
            self._answers_shared = True
        return self

    @cached_property
    def first(self) -> DataFrame:
        return A.first_answer(self.answers)

    @cached_property
    def first_rows(self) -> DataFrame:
        from fieldcast.operators.util import tasks_for
        tasks = tasks_for(self.spark, self.table("lineitem").count())
        if not tasks:
            return A.first_answer_rows(self.answers)
        return A.first_answer_rows(self.answers, None, None, tasks, A.hot_profiles(self.profiles))

    @cached_property
    def meta(self) -> DataFrame:
        """Metadata comes from every answer cell, profile or not (as the raw input
        is read); the long table is used when it is already written."""
        src = self.__dict__["answers"] if getattr(self, "_answers_shared", False) \
            else A.clean_indicators(self.raw_answers)
        return M.question_meta(src, self.spark)

    @cached_property
    def items(self) -> DataFrame:
        return FX.items(self.spark, self.sf_dir)

    @cached_property
    def feedback(self) -> DataFrame:
        return FX.feedback(self.spark, self.sf_dir)

    @cached_property
    def models(self) -> DataFrame:
        return FX.model_metrics(self.spark, self.sf_dir)

    @cached_property
    def registry_log(self) -> DataFrame:
        return FX.registry_log(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return FX.table(self.spark, self.sf_dir, name)


PROFILE_COLS = C.FEATURE_COLUMNS
