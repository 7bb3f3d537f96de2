"""Exact deduplication through counting quotient filters (operator 9).

Each partition puts the 64-bit fingerprints of its normalised texts into a counting quotient filter.
The filters travel in pieces, one for each range of leading fingerprint bits, and the pieces of a range
are merged losslessly by their sorted remainders. A copy group of any size is one slot of each filter,
so no key is hot. Only fingerprints with a count above one go on to byte verification, which groups
the whole normalised texts; all other documents are known to be alone.

Defined results. A null text counts as empty, and all empty texts are equal. Ties go to the smallest
doc_id; a null doc_id comes last. Of rows repeated with the same doc_id and text all are listed, and
only one is kept. An empty table gives an empty result. Other columns are ignored by ``copy_groups``
and kept by ``drop_copies``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, table, without_spaces, written
from .quotient import CountingQuotientFilter

#: Fingerprints that one range of the merge should hold.
RANGE_ROWS = 250_000

#: Packed doc_ids: 0 to 2^64 - 1 for -2^63 to 2^63 - 1, and 2^64 for null, which so comes last.
_TWO_64, _TWO_65 = "18446744073709551616", "36893488147419103232"


def _filters(bits: int, batch_rows: int = 2_000_000):
    def build(batches):
        held, rows = [], 0

        def pieces():
            whole = CountingQuotientFilter.build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            for prefix, piece in whole.split(bits):
                yield pa.RecordBatch.from_pydict({"range": pa.array([prefix], pa.int32()), "filter": pa.array([piece.to_bytes()], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)))
                rows += batch.num_rows
            if rows >= batch_rows:
                yield from pieces()
                held, rows = [], 0
        if held:
            yield from pieces()

    return build


def _merged(pdf):
    import pandas as pd

    whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(b) for b in pdf["filter"]])
    values, counts = whole.items()
    many = counts > 1
    return pd.DataFrame({"fp": values[many].view(np.int64), "copies": counts[many].astype(np.int64)})


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, copies) of every fingerprint that occurs more than once in prints(fp, mult)."""
    bits = max(6, int(np.ceil(np.log2(max(1, rows) / RANGE_ROWS))) if rows else 0)
    filters = prints.select("fp", "mult").mapInArrow(_filters(bits), "range int, filter binary")
    return filters.groupBy("range").applyInPandas(_merged, "fp long, copies long")


def copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text, ...)."""
    return _sized_groups(docs).drop("chars")


def _sized_groups(docs: DataFrame) -> DataFrame:
    """copy_groups with the length of each text, which tells rows of one doc_id apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shown = own.select("doc_id", F.length("text").alias("chars"), without_spaces(F.col("text")).alias("norm"))
    prints = written(
        shown.select("doc_id", "chars", F.xxhash64("norm").alias("fp"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
        .groupBy("doc_id", "chars", "fp", "sha").agg(F.count(F.lit(1)).alias("mult")),
        "prints",
    )
    rows = prints.count()
    again = written(repeated_fingerprints(prints, rows), "repeated")
    n_again = again.count()
    # Byte verification: only texts whose fingerprint repeats move, grouped by all their bytes. The
    # packed number orders by most code points, then smallest doc_id; it is a plain hash aggregate.
    packed = F.expr(f"cast(4294967296 - chars as decimal(38,0)) * {_TWO_65} + coalesce(cast(doc_id as decimal(38,0)) + 9223372036854775808, {_TWO_64})")
    candidates = shown.withColumn("fp", F.xxhash64("norm")).join(maybe_broadcast(again.select("fp"), n_again, 16), "fp")
    verified = (
        candidates.groupBy("fp", "norm")
        .agg(F.min(packed.cast("decimal(38,0)")).alias("best"), F.count(F.lit(1)).alias("n"))
        .select(
            "fp", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "n",
            F.expr(f"cast(nullif(best % {_TWO_65}, {_TWO_64}) - 9223372036854775808 as long)").alias("best_id"),
            F.expr(f"cast(4294967296 - (best - best % {_TWO_65}) / {_TWO_65} as long)").alias("best_chars"),
        )
        .filter("n > 1")
    )
    verified = written(verified, "verified")
    n_groups = verified.count()
    return (
        prints.join(maybe_broadcast(verified, n_groups, 128), ["fp", "sha"], "left")
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("mult").cast("int"))))
        .select(
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (F.coalesce(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("chars") == F.col("best_chars")), F.lit(False)) & (F.col("nth") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
            "chars",
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which copy_groups keeps one for each group of equal texts."""
    flags = _sized_groups(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("kept"), F.col("chars"))).alias("__chars"))
    flags = written(flags, "flags")
    gone = flags.filter("not kept").select("doc_id", "text_sha256")
    multiple = flags.filter("kept and rows > 1").select("doc_id", "text_sha256", "__chars")
    digest = F.sha2(without_spaces(F.col("text")).cast("binary"), 256)
    n_gone = gone.count()
    sha = fresh("sha", docs.columns)
    keyed = docs.withColumn(sha, digest)

    def same(other):
        return keyed["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & (keyed[sha] == other["text_sha256"])

    side = maybe_broadcast(gone, n_gone, 128)
    kept = keyed.join(side, same(side), "left_anti")
    n_multiple = multiple.count()
    if n_multiple:
        once = maybe_broadcast(multiple, n_multiple, 128)
        longest = F.length(F.coalesce(keyed["text"], F.lit(""))) == once["__chars"]
        rows = keyed.join(once, same(once) & longest, "left_semi").dropDuplicates(["doc_id", sha])
        kept = kept.join(once, kept["doc_id"].cast("long").eqNullSafe(once["doc_id"]) & (kept[sha] == once["text_sha256"]), "left_anti").unionByName(rows)
    return kept.drop(sha)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS n,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS nth
  FROM d
)
SELECT doc_id, keep_id, n AS group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": SQL}
