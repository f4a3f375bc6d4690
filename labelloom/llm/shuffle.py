"""Shards by a two-pass external shuffle, in DataFrame functions alone.

Pass one scatters records over memory-sized buckets by a seeded hash; pass two shuffles each bucket by Fisher-Yates
(Spark's own ``shuffle`` of an array) and writes it. A bucket's place in the whole order is known from the bucket counts,
so a record's shard and slot follow from its position, and shards differ by one row at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm import shared
from labelloom.session import shared_dir

SHARDS = 40
SEED = 42
#: Text a bucket is meant to hold; with it the number of buckets follows from the input.
BUCKET_BYTES = 8 << 20
#: The bucket table has one row of 16 bytes per bucket and is broadcast up to so many buckets, joined beyond.
BROADCAST_BUCKETS = 1_000_000


def write_shards(docs: DataFrame, path: str | None = None, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as (record, slot) in one folder per shard, and read it back with ``shard``.

    ``record`` holds the whole input row, so no column name can clash. Null and empty texts, null ids and repeated rows
    are records like any other. Rows alike in id and text fall into one bucket. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.octet_length(text).alias("size"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("th"))
    total = rows.agg(F.sum("size").alias("b")).first().b or 0
    n_buckets = shared.partitions(spark, total, BUCKET_BYTES)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("th")), F.lit(n_buckets)).cast("int"))
    counts = shared.materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    places = F.broadcast(places) if n_buckets <= BROADCAST_BUCKETS else places
    # in order first, so that a task that runs again permutes the same array
    bucket = rows.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "id", "th").groupBy("bucket").agg(F.collect_list("record").alias("all"))
    mixed = bucket.join(places, "bucket").select("before", F.posexplode(F.shuffle("all", F.lit(seed))).alias("pos", "record"))
    least, more = n // n_shards, n % n_shards  # the first ``more`` shards have one row above ``least``
    rank, edge = F.col("before") + F.col("pos"), more * (least + 1)
    shard = F.when(rank < edge, F.floor(rank / F.lit(least + 1))).otherwise(more + F.floor((rank - edge) / F.lit(max(1, least)))).cast("int")
    slot = F.when(rank < edge, rank % F.lit(least + 1)).otherwise((rank - edge) % F.lit(max(1, least))).cast("bigint")
    out = mixed.select("record", slot.alias("slot"), shard.alias("shard"))
    out.write.partitionBy("shard").parquet(path)
    schema = T.StructType([f for f in out.schema.fields if f.name != "shard"] + [T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def layout(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) as read back from the written shards."""
    written = write_shards(docs, id_col=id_col)
    text = F.coalesce(F.col("record.text").cast("string"), F.lit(""))
    return written.select(
        F.col(f"record.{id_col}").cast("bigint").alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
