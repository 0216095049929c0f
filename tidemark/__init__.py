"""Spark-first change-log engine: ordered row changes in, replayable keyed tables out."""
