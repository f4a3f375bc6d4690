"""The given tables, and the corpora the queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.corpus import spread

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        """Explicit schema: no inference job, and columns prune down to the scan."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    @property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    def labelled(self, *extra: str) -> DataFrame:
        """(row_id, text, label in -1/0/1, *extra) for the annotated documents."""
        raw = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0)
        return (self.documents.select("doc_id", "text", *extra).join(self.table("labels"), "doc_id")
                .select(F.col("doc_id").alias("row_id"), "text", raw.alias("label"), *extra))

    def annotated(self, modulus: int = 3) -> DataFrame:
        """All documents under a synthetic annotator; modulus 4 adds an unmapped label."""
        return self.documents.select(F.col("doc_id").alias("row_id"), "text",
                                     (F.col("doc_id") % modulus - 1).cast("int").alias("label"))

    def texts(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("row_id"), "text")

    def texts_with_urls(self) -> DataFrame:
        """Documents with the URL of the page of the same number appended."""
        pages = self.table("pages").select(F.col("page_id").alias("doc_id"), "url")
        return self.documents.select("doc_id", "text").join(pages, "doc_id", "left").select(
            F.col("doc_id").alias("row_id"), F.concat_ws(" ", "text", "url").alias("text"))

    def truth(self) -> DataFrame:
        """(row_id, text, n_chars, label id) of the annotated documents."""
        return self.labelled("n_chars").withColumn("label", F.col("label") + 1)

    def predictions(self, model: str) -> DataFrame:
        """(row_id, n_chars, label, pred): a stand-in model that errs on lengths divisible by
        a number of its own."""
        divisor, shift = {"a": (5, 1), "b": (3, 2), "c": (7, 1)}[model]
        wrong = (F.col("label") + shift) % 3
        return self.truth().select("row_id", "n_chars", "label", F.when(
            F.col("n_chars") % divisor == 0, wrong).otherwise(F.col("label")).alias("pred"))

    def by_model(self, *models: str) -> DataFrame:
        """(model, row_id, n_chars, label, pred) for several models."""
        out = None
        for m in models:
            part = self.predictions(m).withColumn("model", F.lit(m))
            out = part if out is None else out.unionByName(part)
        return out

    def training_log(self) -> DataFrame:
        """Events read as training logs: runs of 2,000 steps, 200 steps per epoch, the last
        step of an epoch being its evaluation."""
        step = F.col("event_id") % 2000
        held = F.col("event_id") % 200 == 199
        return self.table("events").select(
            (F.col("event_id") - step).alias("run_id"), step.alias("step"),
            (step / F.lit(200.0)).alias("epoch"),
            F.when(~held, F.col("value")).alias("loss"), F.when(held, F.col("value")).alias("eval_loss"),
            F.when(held, F.col("value")).alias("macro_f1"))
