"""The corpus pipeline: documents to token files in five stages.

Each stage takes (spark, docs, sf_dir), calls one operator of ``lakesonar.llm`` and
returns a DataFrame that is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``:

1. toxicity: documents scored 0.5 or more go (operator 2, fitted on ``labels``);
2. near-duplicates: one document of each SimHash component stays (operator 4);
3. decontamination: benchmark passages are cut out of texts, documents that are
   mostly such passages go (operator 5);
4. mixing: documents come as often as the source targets ask (operator 10);
5. tokens: bit-plane token files, and their index per document (operator 6).

Null texts stay (they are not toxic, hold no passage) until the mix, which takes words and so
takes none of theirs. Empty input gives empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesonar.llm.common import fresh, write_table
from lakesonar.llm.decontaminate import decontaminate
from lakesonar.llm.mixing import materialize_mix
from lakesonar.llm.queries import MIX_SEED, remainder, table, tokenizer_path
from lakesonar.llm.simhash import deduplicate
from lakesonar.llm.tokens import encode_to_files
from lakesonar.llm.toxicity import learn, score_column
from lakesonar.session import ship_package

# Fixed value: words of a generation in the token stage's memo. The workers have run four stages before, whose memory
# the allocator does not give back in full.
TOKEN_MEMO = 100_000

ORACLE_SQL = None  # no SQL for the learned score, the fingerprints and the tokenizer: see tests/llm/test_pipeline.py


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    machine = learn(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    (score,) = fresh(docs, "_score")
    return docs.withColumn(score, score_column(spark, machine, F.col("text"))).filter(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return materialize_mix(docs, seed=MIX_SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return encode_to_files(docs, tokenizer_path(), memo=TOKEN_MEMO)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
