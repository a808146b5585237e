"""Token counts with a digest cache.

Content digests are joined with the cache under the tokenizer's version digest; only distinct misses
are encoded, and their counts are appended to the cache. The text moves once and only as misses:
each task sends a content at most once, so a text that a third of all rows share costs a row a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_list, id_text, look_up, map_arrow, new_folder, settle
from .tokenization import default_path, encoder, version_digest

#: Digests a task remembers to send a content once; beyond that it starts anew, which only costs rows.
SEEN = 500_000
#: A Spark setting that names the cache's folder, for counts that outlive a call.
CACHE = "spark.sparkloom.tokenCounts"
SCHEMA = "content binary, tokenizer string, n_tokens long"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for text in binary_list(batch, "text"):
            content = hashlib.sha256(text).digest()
            if content not in seen:
                seen.add(content)
                out[0].append(content)
                out[1].append(zlib.compress(text, 1))  # it moves once
        if len(seen) > SEEN:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["content", "text"])


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """(content, n_tokens) of one tokenizer version, unique by content; None if there is no cache yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def default_cache(spark: SparkSession) -> str:
    """The folder in the setting CACHE, which stays between calls, or a new one in the shared folder."""
    return spark.conf.get(CACHE, None) or new_folder(spark, "token-counts")


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, cache: str | None = None, rounds: int = 2) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs (doc_id, text).

    `cache`: a Parquet folder of (content, tokenizer, n_tokens) that grows; None: see default_cache. Documents are counted in
    `rounds`, each of which joins the cache that those before have filled, so a call that fails keeps what is done.
    Nulls: a null text counts as the empty text (0 tokens); a null doc_id is kept.
    Repeated rows come back repeated; an empty table gives an empty result.
    """
    path = tokenizer_path or default_path()
    spark, tokenizer = docs.sparkSession, version_digest(path)
    cache = cache or default_cache(spark)
    rows = id_text(docs)
    text = F.coalesce("text", F.lit(""))
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    digests = settle(rows.select("doc_id", F.unhex(F.sha2(text, 256)).alias("content"), F.octet_length(text).cast("long").alias("n_bytes")))
    for i in range(rounds):
        encode_misses(rows.where(turn == i).select("text"), read_cache(spark, cache, tokenizer), path).select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    wanted = settle(digests.groupBy("content").agg(F.count(F.lit(1)).alias("n")))
    counts = settle(wanted.join(read_cache(spark, cache, tokenizer), "content"))
    return look_up(digests, counts, "content").select("doc_id", "n_bytes", "n_tokens")


def encode_misses(texts: DataFrame, known: DataFrame | None, path: str) -> DataFrame:
    """(content, n_tokens) of the distinct texts whose digest isn't known."""
    misses = map_arrow(texts, _once, "content binary, text binary")
    if known is not None:
        misses = misses.join(known.select("content"), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = encoder(path), set()
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for content, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content not in seen:
                    seen.add(content)
                    out[0].append(content)
                    out[1].append(len(ids(zlib.decompress(text).decode())))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64())], ["content", "n_tokens"])

    return misses.repartition("content").mapInArrow(encode, "content binary, n_tokens long")
