"""Small frames with the awkward rows that every operator must take."""

import functools

from pyspark.sql import types as T

from vellum.llm import secrets

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("spans", "score", "component_id", "n_removed", "labels", "position", "tk", "value", "_text", "fp", "words")]
)


def frame(spark, rows):
    """rows of (doc_id, text[, lang[, source]]), with further columns whose names clash with the operators' own."""
    full = [(r[0], r[1], *(list(r[2:]) + [None] * (2 - len(r[2:]))), len(r[1] or ""), *["x"] * 11) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "alpha beta gamma delta epsilon " * 4000
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, LONG), (None, "a word or two"), (7, "é" * 500), (8, "x")]

_slices = secrets.slices


def sliced(monkeypatch, module, limit=150):
    """Lets a module read its Arrow batches in many slices, as it does on any real table."""
    monkeypatch.setattr(module, "slices", functools.partial(_slices, limit=limit))
