"""fieldcast — questionnaire-assessment analytics on Spark DataFrames.

Answers arrive as a nested list per profile; everything after that is a
DataFrame keyed by ``indicator``: metadata, features, a count model that
trains every indicator in one aggregation, batch prediction, scores,
history tables, explanations, neighbour look-ups and a feedback stream.
"""

__version__ = "0.1.0"
