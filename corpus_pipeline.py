"""A corpus pipeline over the table ``documents``: rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet into the folder that the cluster shares
and reads them again, so a lost executor never costs more than a stage. Stages that name documents by doc_id
(near-dedup) leave out rows without one; see the operators for other special input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fidelis.llm import decontamination, line_dedup, near_dup, quality_rules, sentencepiece
from fidelis.llm.store import drop_folder, new_folder
from fidelis.session import ship

TOKENIZER = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the table of quality rules keeps."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that they share with an earlier one; n_chars counts what is left."""
    ship(spark)
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of near copies (five words, similarity 0.8)."""
    ship(spark)
    return near_dup.representatives(docs, 5, 80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, nor one with other numbers or names."""
    ship(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the tokens of each document: ids, how many, and digests of ids and decoded text."""
    import public_tokenizers

    ship(spark)
    return sentencepiece.encoded(docs, public_tokenizers.path(TOKENIZER), ids=True)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", tokens),
]

#: Near-dedup and patience alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
