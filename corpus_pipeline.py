"""Documents to token ids in five stages: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import shared
from tallyforge.llm.bpe import encoded
from tallyforge.llm.decontamination import decontaminated
from tallyforge.llm.language import in_known_language, train
from tallyforge.llm.line_dedup import deduplicated
from tallyforge.llm.near_dedup import near_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. Those without letters and ambiguous ones go. The classifier learns from the
    stage's own labelled rows."""
    docs = shared.cased(docs, *COLUMNS)
    return in_known_language(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line repeats; ``n_chars`` follows. A document all of whose text was
    such lines has nothing left and goes; one that was empty before stays."""
    left = deduplicated(shared.cased(docs, *COLUMNS), shortest=1)
    gone = (F.col("n_dropped") > 0) & (F.trim("text", F.lit(" \n")) == "")
    return left.filter(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (null last), of each group of near-duplicates (five-word shingles, similarity
    of 0.8 or more). Rows are told apart by a number of their own, so that repeated and null ids and those of several
    texts are decided row by row. Texts without words have no duplicates and stay."""
    docs = shared.cased(docs, *COLUMNS).withColumns({"row": F.monotonically_increasing_id(), "hash": F.xxhash64("text")})
    docs = shared.materialised(docs, "numbered")
    groups = shared.materialised(near_groups(docs, n=5, percent=80, key="row").select("row", "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "row")
    first = groups.join(docs.select("row", "doc_id", "hash"), "row").groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    dropped = groups.join(first, "component_id").filter(F.col("row") != F.col("first.row")).select("row")
    return docs.join(dropped, "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminated(shared.cased(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and the text that they decode to."""
    return encoded(shared.cased(docs, *COLUMNS), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]
#: A classifier, edit distances and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.materialised(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
