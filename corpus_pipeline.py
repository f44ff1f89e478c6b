"""Training-data pipeline over `documents`; part of the subpackage llm.

Stages, each on all that the one before kept:
 1. toxicity: rows whose text is predicted toxic go.
 2. SimHash near-dedup: of each class of like documents one stays, the one with the smallest doc_id
    (then by a hash of the text; rows of equal doc_id and text are one).  Like means: sets of
    five-word shingles with a Jaccard similarity of 0.8 or more, directly or through others; each
    link is checked on the sets (llm/neardup.py).  Rows are told apart by doc_id and text, so unlike
    texts under one doc_id all stay.
 3. benchmark decontamination: rows that hold a benchmark window go.
 4. PII: spans are masked in the text.
 5. BPE: token ids of every text.

Null texts are empty texts (kept through stage 1, one of them stays in stage 2).  A null doc_id
comes after all others.  Empty tables pass through.  Extra columns, whatever their names, are kept up
to stage 4.  A stage's table is deleted once the next one is written; the last stays in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import bpechunk, neardup, pii, toxicity, winnow
from loomwell.llm.common import delete_folder, ready, shared_folder, table
from loomwell.llm.queries import tokenizer_path

SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return neardup.keep_first(docs, SHINGLE, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return bpechunk.encode(docs, tokenizer_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: Hash families, a trained field and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet in the shared folder and read again."""
    work = shared_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        made = f"{work}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(made)
        docs = spark.read.parquet(made)
        if before is not None:
            delete_folder(spark, before)
        before = made
    return docs
