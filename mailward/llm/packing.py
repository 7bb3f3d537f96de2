"""Packing into optimal length buckets (operator 3).

The lengths of all documents make one histogram; dynamic programming over it picks the bucket
boundaries that minimise padding when every document is padded to its bucket's boundary. Inside each
bucket documents form batches that fit a token budget.

The histogram has a bounded number of bins whatever the input (every length below EXACT, then 256 to
an octave), and boundaries are lengths that occur, so the programme's cost is the true padding of its
buckets. A bucket is dealt into as many shards as its count asks for, so that no task numbers more than
about SHARD_ROWS documents, and each shard fills its own batches.

Lengths are ids of the byte-pair vocabulary where one is given, as in the pipeline. ``op3_packing`` gives none:
its n_tokens, and so its budget and padding, count words.

Defined results. A null or empty text has length 0. A document longer than the budget is a batch of
its own, whole. Ties are ordered by doc_id. Repeated rows are packed each. An empty table gives an
empty result. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, pieces, table, written
from .wordbpe import codec

EXACT = 2048
SHARD_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_bin(length: Column) -> Column:
    step = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 8).cast("long")
    return F.when(length < EXACT, length).otherwise(F.ceil(length / step).cast("long") * step)


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Ascending boundaries, the last one the largest length, with the least padding in total.

    lengths: the largest length of each bin, ascending; counts and sums: documents and tokens of it.
    """
    n = len(lengths)
    if not n:
        return []
    size = lengths.astype(np.float64)
    c, s = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64), np.concatenate([[0], np.cumsum(sums)]).astype(np.float64)
    # least[j]: padding of the first j bins in k buckets; a bucket i..j-1 costs size[j-1] * count - tokens.
    least = np.full(n + 1, np.inf)
    least[0] = 0.0
    back = []
    for _ in range(min(buckets, n)):
        nxt, came = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        nxt[0] = 0.0
        for j in range(1, n + 1):
            cost = least[:j] + size[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            i = int(np.argmin(cost))
            nxt[j], came[j] = cost[i], i
        back.append(came)
        least = nxt
    out, j = [], n
    for came in reversed(back):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(came[j])
    return sorted(set(out))


def histogram(docs: DataFrame, length: str) -> list:
    """(largest length, documents, tokens) of each bin; a bounded number of rows."""
    return docs.groupBy(length_bin(F.col(length)).alias("bin")).agg(F.max(length).alias("most"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("tokens")).orderBy("most").collect()


def pack(docs: DataFrame, length: str, buckets: int = 16, budget: int = 32_768) -> DataFrame:
    """docs (doc_id, a long column of lengths, ...) with bucket, bucket_length, batch_id, slot, padding.

    Columns of docs that are called like one of these five give way; all others pass through.
    """
    made = ("bucket", "bucket_length", "batch_id", "slot", "padding")
    docs = docs.select(*[docs[c] for c in docs.columns if c.lower() not in made])
    shard_of, room_of, nth_of = (fresh(c, docs.columns) for c in ("shard", "room", "nth"))
    found = histogram(docs, length)
    lengths, counts, sums = (np.array([r[k] for r in found], np.int64) for k in ("most", "n", "tokens"))
    bounds = best_boundaries(lengths, counts, sums, buckets) or [0]
    size = F.col(length)
    bucket, limit, shards, room = F.lit(len(bounds) - 1), F.lit(bounds[-1]), F.lit(1), F.lit(1)
    for k in reversed(range(len(bounds))):
        inside = (lengths <= bounds[k]) & (lengths > (bounds[k - 1] if k else -1))
        here = size <= bounds[k]
        bucket, limit = F.when(here, k).otherwise(bucket), F.when(here, F.lit(bounds[k])).otherwise(limit)
        shards = F.when(here, max(1, int(np.ceil(counts[inside].sum() / SHARD_ROWS)))).otherwise(shards)
        room = F.when(here, max(1, budget // max(1, bounds[k]))).otherwise(room)
    dealt = docs.select("*", bucket.alias("bucket"), limit.cast("long").alias("bucket_length"), F.pmod(F.xxhash64("doc_id", size), shards.cast("long")).alias(shard_of), room.cast("long").alias(room_of))
    nth = F.row_number().over(Window.partitionBy("bucket", shard_of).orderBy("doc_id", length)) - 1
    return (
        dealt.withColumn(nth_of, nth.cast("long"))
        .withColumn("batch_id", F.format_string("%d-%d-%d", "bucket", shard_of, F.floor(F.col(nth_of) / F.col(room_of)).cast("long")))
        .withColumn("slot", F.pmod(nth_of, room_of))
        .withColumn("padding", F.col("bucket_length") - size)
        .drop(shard_of, room_of, nth_of)
    )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens: how many ids the vocabulary file of that path gives each whole text."""

    def run(batches):
        own = codec(path)
        for batch in pieces(batches):
            counts = [own.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def pack_texts(docs: DataFrame, buckets: int = 16, budget: int = 32_768, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the packing of every document by its ids under a vocabulary file, or else by its words."""
    if vocabulary:
        lengths = token_counts(docs, vocabulary)
    else:
        lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("n_tokens"))
    return pack(written(lengths, "lengths"), "n_tokens", buckets, budget)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
