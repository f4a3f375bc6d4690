"""Column expressions over numeric arrays and the Spark ML vector boundary."""

from __future__ import annotations

import json

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def softmax(logits: Column) -> Column:
    """exp(x - max) / sum; the row maximum travels as an array so that it is computed once."""
    peak = F.array_repeat(F.array_max(logits), F.size(logits))
    powers = F.zip_with(logits, peak, lambda x, m: F.exp(x - m))
    total = F.array_repeat(
        F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x), F.size(logits))
    return F.zip_with(powers, total, lambda x, s: x / s)


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def pad(ids: Column, length: int, pad_id: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id).cast("int"), length)), 1, length)


def attention_mask(ids: Column, length: int) -> Column:
    ones = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(length) - ones))


def double_array(values: list[float]) -> Column:
    """A constant array<double> built from one literal instead of one expression per element."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def l2_normalise(values: Column) -> Column:
    """Scale to unit length; an all-zero or empty array stays as it is."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.zip_with(values, F.array_repeat(norm, F.size(values)),
                      lambda x, n: F.when(n > 0, x / n).otherwise(x))


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """ML vector from parallel arrays without a Python worker.

    SQL has no constructor for vectors, but the JSON reader fills user-defined types
    from their storage struct, and doubles survive the text form exactly.
    """
    schema = T.StructType([T.StructField("v", VectorUDT())])
    parts = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"),
                     indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema)["v"]
