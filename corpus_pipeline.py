"""A corpus pipeline of five stages: each takes what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next one's docs. All but the last
return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, packing, simhash_similarity, substring, toxicity
from sparkloom.llm.common import free_shuffles, give_back, new_folder, settle, table

#: SQL can't express the trained, hashed and tokenised stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.3 or more. The model is fitted on documents of this stage and their labels."""
    free_shuffles(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    give_back(spark)  # the sample's texts and words
    rejected = toxicity.score(docs, model).where((F.col("score") >= 0.3) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(settle(rejected), "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the document with the smallest doc_id.

    Groups are linked by a similarity (cosine) of 0.8 or more of five-word shingle sets, which is checked exactly.
    """
    free_shuffles(spark)
    groups = simhash_similarity.near_duplicates(docs, similarity=0.8, words_in_shingle=5)
    copies = settle(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has; texts without any stay as they are.

    A document that loses words continues as its kept words joined by one space, and one of which
    nothing is left goes.
    """
    free_shuffles(spark)  # the near-duplicate stage before has run hundreds of jobs
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = substring.remove_repeats(docs, carry=("text", *others)).where("n_removed = 0 or kept_text <> ''")
    give_back(spark)  # copies of the sketch
    lost = F.col("n_removed") > 0
    changed = {"doc_id": F.col("doc_id"), "text": F.when(lost, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in others:
        changed["n_chars"] = F.when(lost, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    free_shuffles(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining texts into sequences of 2048 tokens."""
    free_shuffles(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
