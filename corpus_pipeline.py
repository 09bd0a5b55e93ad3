"""The corpus pipeline: five stages over ``documents``, each written and read again.

All stages take texts of any length, repeated rows, rows without a doc_id and
empty tables; all but the last keep every column, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.llm import decontaminate, line_dedup, minhash, packing, quality
from tripmart.llm.common import cut, fresh, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty ones, repeated rows alike. Without
    labels of both classes nothing is learnt and all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one; n_chars follows the text.

    A null text becomes an empty one. Rows of one doc_id are one document; rows
    without one count as no document, and lose shared lines.
    """
    aside = {c: fresh(docs, f"own_{c}")[0] for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    out = line_dedup.drop_lines(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        text = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", text.cast(dict(docs.dtypes)["n_chars"]))
    return out.drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in aside.items()}).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Each row goes by its own text; null, empty and wordless texts and rows
    without a doc_id stay, and so do repeated rows of the one that is kept.
    """
    return minhash.keep_one(docs, k=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, repeated rows alike; null and empty texts stay, and all with an empty benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences; null and empty texts are their closing id, repeated rows are packed each, other columns go."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: The classifier's statistics and the tokenizer's merges can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
