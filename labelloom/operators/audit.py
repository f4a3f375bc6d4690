"""Data-quality audits. Each is one pass over the corpus ending in a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import chars
from labelloom.functions import text as tx


def duplicate_audit(df: DataFrame) -> DataFrame:
    """Repeat and conflict counts. Only digests are shuffled, pre-aggregated per task."""
    pairs = (df.select(tx.text_key(F.col("text")).alias("key"), "label")
               .groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")))
    texts = pairs.groupBy("key").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"), F.count("label").alias("labels"))
    conflict = F.col("labels") > 1
    return texts.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - F.col("pairs")).alias("exact_repeats"),
        F.sum(F.col("n") - 1).alias("text_repeats"),
        F.sum(F.col("pairs") - 1).alias("text_minus_exact"),
        F.count_if(conflict).alias("conflict_texts"),
        F.sum("pairs").alias("rows_after_exact"),
        F.sum(F.when(~conflict, F.col("pairs")).otherwise(0)).alias("rows_after_conflicts"),
    )


def label_conflict_pairs(df: DataFrame, domain: list[int] | None = None) -> DataFrame:
    """Symmetric (label_a, label_b, n): texts annotated with both labels, zero cells included.

    One flag per label of the domain replaces the self join, so no pairs of rows exist.
    """
    domain = domain or settings.RAW_LABELS
    flags = (df.groupBy(tx.text_key(F.col("text")).alias("key"))
               .agg(*[F.max(F.col("label").eqNullSafe(v)).alias(f"has_{i}")
                      for i, v in enumerate(domain)]))
    cells = [(i, j) for i in range(len(domain)) for j in range(len(domain))]
    counted = flags.agg(*[
        (F.count_if(F.col(f"has_{i}") & F.col(f"has_{j}")) if i != j
         else F.lit(0).cast("long")).alias(f"c_{i}_{j}") for i, j in cells])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(domain[i]).alias("label_a"), F.lit(domain[j]).alias("label_b"),
                 F.col(f"c_{i}_{j}").alias("n")) for i, j in cells])))


def class_distribution(df: DataFrame, labels: list[int], decimals: int = 2) -> DataFrame:
    """(label, n, pct) for every label of the domain, zero counts included."""
    counted = df.agg(F.count("label").alias("total"), *[
        F.count_if(F.col("label") == v).alias(f"n_{i}") for i, v in enumerate(labels)])
    rows = counted.select("total", F.inline(F.array(*[
        F.struct(F.lit(v).alias("label"), F.col(f"n_{i}").alias("n"))
        for i, v in enumerate(labels)])))
    share = F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0))
    return rows.select("label", "n", F.round(share, decimals).alias("pct"))


def noise_audit(df: DataFrame) -> DataFrame:
    """Rows matching each noise pattern, all patterns in one scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(text.rlike(p)).alias(name) for name, p in chars.NOISE.items()])
    rows = counted.select("total", F.inline(F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.col(name).alias("n")) for name in chars.NOISE])))
    return rows.select("pattern", "n",
                       F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 4).alias("pct"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])))


def script_mix(df: DataFrame, first_rows: int | None = None) -> DataFrame:
    """Mean share in percent of Devanagari, Latin, digit, whitespace and other characters.

    Devanagari digits count in two classes, so ``other`` can be understated. All rows are
    used unless ``first_rows`` asks for the first rows by ``row_id``.
    """
    if first_rows is not None:
        df = df.orderBy("row_id").limit(first_rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    classes = {"devanagari": chars.DEVANAGARI, "latin": chars.LATIN,
               "digit": chars.ANY_DIGIT, "whitespace": chars.SPACE}
    counted = df.select(F.length(text).alias("len"), *[
        tx.class_count(text, p).alias(name) for name, p in classes.items()])
    other = F.col("len") - sum(F.col(name) for name in classes)
    counted = counted.withColumn("other", other)
    size = F.greatest(F.col("len"), F.lit(1))
    return counted.agg(*[F.round(F.avg(F.col(c) / size) * 100, 4).alias(c)
                         for c in [*classes, "other"]])


# Lengths. A corpus has few distinct lengths, so every statistic below works on
# (unit, length, n), which one pre-aggregated pass produces.

def length_counts(df: DataFrame) -> DataFrame:
    """(unit, length, n) for characters and whitespace-separated words."""
    measured = df.select(tx.char_count(F.col("text")).alias("chars"),
                         F.size(tx.words(F.col("text"))).alias("words"))
    long = measured.select(F.inline(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")),
        F.struct(F.lit("words").alias("unit"), F.col("words").alias("length")))))
    return long.groupBy("unit", "length").agg(F.count(F.lit(1)).alias("n"))


def counts_of(lengths: DataFrame, column: str, unit: str) -> DataFrame:
    """The same table from one ready-made length column."""
    return (lengths.groupBy(F.col(column).alias("length")).agg(F.count(F.lit(1)).alias("n"))
                   .select(F.lit(unit).alias("unit"), "length", "n"))


def length_summary(counts: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact linear quantiles per unit."""
    unit = Window.partitionBy("unit")
    x, n = F.col("length").cast("double"), F.col("n")
    mean = F.sum(x * n).over(unit) / F.sum(n).over(unit)
    quantiles = F.array(*[F.lit(q) for q in (0.5, 0.9, 0.95, 0.99)])
    out = counts.withColumn("_mean", mean).groupBy("unit").agg(
        F.sum("n").alias("n_rows"), F.max("_mean").alias("mean"),
        F.sqrt(F.try_divide(F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean"))),
                            F.sum(n) - 1)).alias("std"),
        F.min("length").alias("min"), F.max("length").alias("max"),
        F.percentile(x, quantiles, n).alias("q"))
    return out.select("unit", "n_rows", F.round("mean", 6).alias("mean"),
                      F.round("std", 6).alias("std"), "min",
                      *[F.round(F.col("q")[i], 6).alias(name)
                        for i, name in enumerate(["p50", "p90", "p95", "p99"])], "max")


def truncation_share(counts: DataFrame, cutoffs: list[int] | None = None) -> DataFrame:
    """Percent of rows longer than each cutoff, per unit."""
    cutoffs = cutoffs or settings.LENGTH_CUTOFFS
    return counts.groupBy("unit").agg(*[
        F.round(F.sum(F.when(F.col("length") > k, F.col("n")).otherwise(0)) * 100.0
                / F.sum("n"), 6).alias(f"pct_over_{k}") for k in cutoffs])


def recommend_max_length(counts: DataFrame, current: int = settings.MAX_LENGTH,
                         step: int = settings.LENGTH_STEP) -> DataFrame:
    """p99 rounded up to a multiple of ``step``, against the current setting."""
    p99 = counts.groupBy("unit").agg(
        F.percentile(F.col("length").cast("double"), F.lit(0.99), F.col("n")).alias("p99"))
    suggested = (F.ceil(F.col("p99") / step) * step).cast("int")
    out = p99.select("unit", F.round("p99", 6).alias("p99"), F.lit(current).alias("current"),
                     suggested.alias("suggested"))
    s, c = F.col("suggested"), F.col("current")
    return (out.withColumn("saving_pct", F.when(
                s < c, F.round((1 - s / c) * 100, 4)).otherwise(F.lit(0.0)))
               .withColumn("advice", F.when(s < c, "shrink").when(s > c, "grow").otherwise("keep")))


def length_histogram(counts: DataFrame, bins: int = settings.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over lengths clipped at int(p99); the last bin is closed."""
    unit = Window.partitionBy("unit")
    p99 = counts.groupBy("unit").agg(F.floor(F.percentile(
        F.col("length").cast("double"), F.lit(0.99), F.col("n"))).cast("int").alias("cap"))
    x = F.least("length", "cap")
    clipped = counts.join(p99, "unit").select(
        "unit", "n", x.alias("x"), F.min(x).over(unit).alias("_lo"), F.max(x).over(unit).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    lo = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo").cast("double"))
    hi = F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi").cast("double"))
    placed = clipped.select("unit", "n", "x", lo.alias("lo"), ((hi - lo) / bins).alias("width"))
    slot = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counted = (placed.groupBy("unit", "lo", "width", slot.alias("bin"))
                     .agg(F.sum("n").alias("n")))
    dense = counted.groupBy("unit", "lo", "width").agg(*[
        F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0).cast("long")).alias(f"b{b}")
        for b in range(bins)])
    return dense.select(
        "unit", "lo", "width", F.posexplode(F.array(*[F.col(f"b{b}") for b in range(bins)]))
        .alias("bin", "n")).select(
        "unit", "bin", F.round(F.col("lo") + F.col("bin") * F.col("width"), 6).alias("left_edge"), "n")
