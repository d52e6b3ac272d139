"""From documents to a mixed training corpus: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`, whatever columns those are. Rows of the result: see `source_mix.mix`.

Defined results: NULL and empty texts, and texts without a word, fail the quality rules; an empty
`documents` gives an empty mix; an empty benchmark removes nothing. Of repeated rows the first keeps
its lines and the others go with theirs; rows with a NULL doc_id come last in every order and are
kept as they are by the near-duplicate stage. Texts of any length pass whole through every stage.
Further columns, also of names that stages use themselves, are passed on as they are; n_chars, where
there is such a column, is counted anew when lines go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veritally.llm import decontamination, kit, line_dedup, minhash_hamming, quality_ledger, source_mix
from veritally.session import remove_folder, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return quality_ledger.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those of which nothing is left go."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return minhash_hamming.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontamination.uncontaminated(docs, kit.read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes."""
    return source_mix.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("source mix", mixed),
]

#: The tiling of the fourth stage has no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's table goes when the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, written = kit.read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            remove_folder(spark, written)
        written = path
    return docs
