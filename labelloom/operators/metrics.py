"""Classification metrics from (label, pred).

The counts are conditional sums in one aggregate; everything after that is arithmetic on one
row per model, without joins or further shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import settings

K = settings.NUM_CLASSES


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _cell(t: int, p: int) -> Column:
    return F.col(f"c_{t}_{p}")


def confusion_record(df: DataFrame, by: list[str] | None = None, classes: int = K) -> DataFrame:
    """One wide row (per group of ``by``): cells c_<true>_<pred>, then rows by true class
    t_<class>, rows by prediction p_<class>, and all rows that have a label.

    A row whose prediction is missing or no class is wrong, but counted; a row without a
    label is not judged.
    """
    known = F.col("label").isNotNull()
    cells = [F.count_if((F.col("label") == t) & (F.col("pred") == p)).alias(f"c_{t}_{p}")
             for t in range(classes) for p in range(classes)]
    true = [F.count_if(F.col("label") == t).alias(f"t_{t}") for t in range(classes)]
    pred = [F.count_if(known & (F.col("pred") == p)).alias(f"p_{p}") for p in range(classes)]
    return df.groupBy(*(by or [])).agg(*cells, *true, *pred, F.count_if(known).alias("judged"))


def classes_of(record: DataFrame) -> int:
    return sum(c.startswith("t_") for c in record.columns)


def name_of(c: int, classes: int) -> str:
    return settings.LABEL_NAMES[c] if classes == K else str(c)


def confusion_matrix(record: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(label, pred, n), every cell present."""
    k = classes_of(record)
    return record.select(*(by or []), F.inline(F.array(*[
        F.struct(F.lit(t).alias("label"), F.lit(p).alias("pred"), _cell(t, p).alias("n"))
        for t in range(k) for p in range(k)])))


def confusion_matrix_norm(record: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(label, pred, share of the true class); a class without rows gives zeros."""
    k = classes_of(record)
    return record.select(*(by or []), F.inline(F.array(*[
        F.struct(F.lit(t).alias("label"), F.lit(p).alias("pred"),
                 F.round(_ratio(_cell(t, p), F.col(f"t_{t}")), 6).alias("share"))
        for t in range(k) for p in range(k)])))


def _scores(k: int) -> tuple[list[Column], list[Column], list[Column], list[Column]]:
    precision, recall, f1, support = [], [], [], []
    for c in range(k):
        predicted, actual = F.col(f"p_{c}"), F.col(f"t_{c}")
        precision.append(_ratio(_cell(c, c), predicted))
        recall.append(_ratio(_cell(c, c), actual))
        f1.append(_ratio(2 * _cell(c, c), predicted + actual))
        support.append(actual)
    return precision, recall, f1, support


def _overall(k: int) -> dict[str, Column]:
    precision, recall, f1, support = _scores(k)
    rows, known = F.col("judged"), _total(support)
    weighted = [_total([x * s for x, s in zip(xs, support)]) for xs in (precision, recall, f1)]
    return {
        "accuracy": _ratio(_total([_cell(c, c) for c in range(k)]), rows),
        "macro_precision": _total(precision) / k,
        "macro_recall": _total(recall) / k,
        "macro_f1": _total(f1) / k,
        "weighted_precision": _ratio(weighted[0], known),
        "weighted_recall": _ratio(weighted[1], known),
        "weighted_f1": _ratio(weighted[2], known),
        "n_rows": rows,
    }


HEADLINE = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]


def metrics_overall(record: DataFrame, by: list[str] | None = None, decimals: int = 6) -> DataFrame:
    o = _overall(classes_of(record))
    return record.select(*(by or []), *[F.round(o[m], decimals).alias(m) for m in HEADLINE])


def metrics_per_class(record: DataFrame, by: list[str] | None = None) -> DataFrame:
    k = classes_of(record)
    p, r, f, s = _scores(k)
    return record.select(*(by or []), F.inline(F.array(*[
        F.struct(F.lit(c).alias("label"), F.lit(name_of(c, k)).alias("label_name"),
                 F.round(p[c], 6).alias("precision"), F.round(r[c], 6).alias("recall"),
                 F.round(f[c], 6).alias("f1"), s[c].alias("support")) for c in range(k)])))


def classification_report(record: DataFrame, by: list[str] | None = None, decimals: int = 4) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages."""
    k = classes_of(record)
    p, r, f, s = _scores(k)
    o = _overall(k)
    lines = [(name_of(c, k), p[c], r[c], f[c], s[c]) for c in range(k)]
    lines += [("accuracy", o["accuracy"], o["accuracy"], o["accuracy"], o["n_rows"]),
              ("macro avg", o["macro_precision"], o["macro_recall"], o["macro_f1"], o["n_rows"]),
              ("weighted avg", o["weighted_precision"], o["weighted_recall"], o["weighted_f1"], o["n_rows"])]
    return record.select(*(by or []), F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("row"),
                 F.round(a, decimals).alias("precision"), F.round(b, decimals).alias("recall"),
                 F.round(c, decimals).alias("f1"), n.alias("support"))
        for i, (name, a, b, c, n) in enumerate(lines)])))


def flat_metrics(record: DataFrame, by: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """One row per model: headline scores, then <metric>_<class> columns."""
    k = classes_of(record)
    p, r, f, s = _scores(k)
    o = _overall(k)

    def shown(c: Column) -> Column:
        return c if decimals is None else F.round(c, decimals)

    per_class = [shown(vals[c]).alias(f"{m}_{name_of(c, k)}")
                 for m, vals in (("precision", p), ("recall", r), ("f1", f)) for c in range(k)]
    supports = [s[c].alias(f"support_{name_of(c, k)}") for c in range(k)]
    return record.select(*(by or []), *[shown(o[m]).alias(m) for m in HEADLINE], *per_class, *supports)
