"""Corpus pipeline over ``documents``: toxicity, line dedup, n-gram Jaccard join, secret scan, packing.

Each stage reads what the one before it kept, written as Parquet. All but the last return the columns of
``documents``, with the texts that the stage leaves; packing returns the pieces of its sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimshot.llm import jaccard, linededup, packing, secrets, toxicity
from rimshot.llm.registry import table
from rimshot.session import checkpoint_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of runs of lines; documents that were such copies as a whole go."""
    return linededup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one with the smallest id; documents without an id or a word stay.

    Rows of one id are judged each by its text: of a group one (id, text) stays, also where another group has the same
    id. Equal rows are one document.
    """
    taken = {c.lower() for c in docs.columns}
    content, key, keep, many = (next(n + "_" * k for k in range(len(taken) + 1) if n + "_" * k not in taken)
                                for n in ("_content", "_key", "_keep", "_many"))
    found = jaccard.link_components(docs, content=True).checkpoint()
    # one (id, set) a group; sets without a group are kept as they are
    first = (found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "c")).alias("f"))
             .select("f.doc_id", "f.c", F.lit(True).alias(keep)))
    marks = (found.groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("n"), F.max("component").alias("component"))
             .join(first, ["doc_id", "c"], "left")
             .filter(F.col(keep) | F.col("component").isNull())
             .select(F.col("doc_id").alias(key), F.col("c").alias(keep), (F.col("n") > 1).alias(many)))
    rows = jaccard.with_content(docs, "text", content)
    kept = rows.join(marks, (rows[content] == marks[keep]) & rows["doc_id"].cast("long").eqNullSafe(marks[key]))
    kept = kept.select(*[rows[c] for c in docs.columns], content, many).checkpoint()
    single = kept.filter(~F.col(many)).select(*docs.columns)
    # repeated rows of one id and set: equal ones first, then those that differ in signs that shingles do not see
    equal = kept.filter(many).select(*docs.columns, content).dropDuplicates()
    order = Window.partitionBy("doc_id", content).orderBy(F.xxhash64("text"))
    named = F.col("doc_id").isNotNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    one = equal.withColumn(many, F.row_number().over(order)).filter(~named | (F.col(many) == 1)).select(*docs.columns)
    return single.unionByName(one)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in a text replaced by ``[SECRET]``."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all texts."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: No SQL for trained models and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage gives; every stage's rows are written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
