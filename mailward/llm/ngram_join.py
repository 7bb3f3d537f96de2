"""Jaccard self-join on word shingles by token-combination prefixes (operator 1).

A document becomes the set of its hashed shingles. Equal sets form a class, and one class is one node.
All tokens have a global order: rare ones first, then classes of rising frequency. Let two sets link, with
e tokens of the one outside the other at most, and d outside either at most. Their first common token is
among the first e + 1 of each. If it is rare, the rare tokens there, indexed alone, meet. If it is frequent,
so are all common ones. Frequent tokens are indexed in combinations of k neighbours in the order, where k
rises with the frequency class of the first. A token outside the other set breaks k - 1 combinations at
most, so of the first (k - 1)(d + 1) + 1 common tokens one combination stays whole in both sets: the prefix is
extended that far, and the combinations in it, as many as it has tokens, meet. Small sets and low
similarities have too few common tokens for a large k; cap_of gives the largest that is safe for the
smaller set of a pair, and a set indexes its combinations for each cap that a partner may ask for.

Candidates are verified on whole sets, in two steps that never list all pairs of a group. Each node is
first checked against one node that leads its postings, which joins groups of near copies into
components. Afterwards the postings that still hold several components are gathered by their smallest
component, each node once, and compared in cells of bounded size, across components and within the lengths
that a link allows; parity bitmaps, whose distance never exceeds that of the sets, rule pairs out inside a
cell, before a pair is written or a text is read. A cell gives the nearest partners of each node, in rounds:
one at first, more when few of them prove to be links, until each pair left is verified.

Frequencies come from a histogram of all tokens over hash buckets of fixed number (a bounded array, also
when it is broadcast). It only decides the order of tokens, never a result.

Words and shingles are compared by 64-bit hashes (words by a polynomial modulo 2**64, whose collisions could
be constructed on purpose). Defined results: null, empty and blank texts have no shingles and link with
nothing. Fewer words than a shingle has are one shingle. Repeated rows are equal sets. A null doc_id comes
last. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, few, fresh, maybe_broadcast, released, small_batches, table, written
from .components import components, merged
from .shingles import mix, shingle_sets

BUCKET_BITS = 20
BLOCKS = 64
#: Tokens of buckets that exceed the median by so many rows (and by the noise of the median) are frequent.
FREQUENT = 32
#: Tokens of a combination, by the rows of its first token: two, from 2**8 rows three, from 2**11 rows four.
THREE, FOUR = 9, 12
MOST = 4
#: Bits of the smallest and the largest parity bitmap; in between, four times the tokens and more.
PARITY_BITS, PARITY_MOST = 512, 1 << 16
#: Bytes of one block of a cell: of its bitmaps, and ROW_BYTES for each row, which bounds the pairs compared in a task.
BLOCK_BYTES, ROW_BYTES = 4 << 20, 512


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _node(digest: Column, salt: int) -> Column:
    return F.xxhash64(digest, F.lit(salt))


def _parity(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts by hash; a power of two bits, more for larger sets. Halves fold by XOR."""
    size = PARITY_BITS
    while size < min(4 * len(tokens), PARITY_MOST):
        size *= 2
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _summaries(width: int):
    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        waiting, waits = [], 0
        for batch in batches:
            keys, sizes, digests, parities = batch.column(0), [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                sizes.append(len(s))
                digests.append(_digest(s))
                parities.append(_parity(s))
                waiting.append((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                waits += len(s)
                if waits > 1 << BUCKET_BITS:
                    counts += np.bincount(np.concatenate(waiting), minlength=1 << BUCKET_BITS).astype(np.uint32)
                    waiting, waits = [], 0
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int32()), keys, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(parities, pa.binary()), batch.column(2), batch.column(3)],
                names=["block", "doc_id", "n", "digest", "data", "sha", "mark"],
            )
        if waits:
            counts += np.bincount(np.concatenate(waiting), minlength=1 << BUCKET_BITS).astype(np.uint32)
        released()
        if counts.any():
            parts = [p.tobytes() for p in counts.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.binary()), pa.array(parts, pa.binary()), pa.nulls(BLOCKS, pa.binary()), pa.nulls(BLOCKS, pa.int64())],
                names=["block", "doc_id", "n", "digest", "data", "sha", "mark"],
            )

    return run


def _summed(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[block] = held.get(block, 0) + np.frombuffer(data, np.uint32).astype(np.uint64)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "data"])


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """0 for buckets of rare tokens only, then the magnitude of what exceeds the median."""
    middle = float(np.median(counts))
    excess = counts.astype(np.float64) - middle
    bar = max(FREQUENT, 8 * np.sqrt(middle + 1))
    return np.where(excess > bar, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)


def least_common(total: int, percent: int) -> int:
    """Common tokens that two sets of so many tokens together need for a link."""
    return -(-percent * total // (100 + percent))


@cache
def cap_of(n: int, percent: int) -> int:
    """The longest combination that a pair can rely on whose smaller set has n tokens.

    With d tokens outside at most, k - 1 times d + 1 and one more must be common. Equal sets (d = 0) are one class.
    """
    for k in range(MOST, 1, -1):
        room = percent - (k - 1) * (100 - percent)
        if room > 0:
            sums = range(2 * n, max(2 * n, k * (100 + percent) // room + 1))
            needs = ((least_common(s, percent), s) for s in sums)
            if all(s == 2 * c or c >= (k - 1) * (s - 2 * c + 1) + 1 for c, s in needs):
                return k
    return 1


def prefix_keys(tokens: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set, and which of them it also needs as the smaller set of a pair.

    Every pair meets at a key that its smaller set needs as such.
    """
    n = len(tokens)
    if not n:
        return tokens, np.zeros(0, bool)
    level = levels[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.lexsort((tokens, level))
    ranked, level = tokens[order], level[order]
    rare = int(np.searchsorted(level, 1))
    least = -(-percent * n // 100)
    # Tokens that may be missing, and tokens outside either set, as the larger and as the smaller one.
    larger, smaller = n - least, n - least_common(2 * n, percent)
    apart_l = 2 * n - 2 * least_common(2 * n, percent)
    both = n + n * 100 // percent
    apart_s = max(both - 1 - 2 * least_common(both - 1, percent), both - 2 * least_common(both, percent), apart_l)
    keys, small = [ranked[: min(rare, larger + 1)]], [np.arange(min(rare, larger + 1)) <= smaller]
    pool, hot = ranked[rare:], level[rare:]
    if rare <= larger and len(pool):
        wanted = 2 + (hot >= THREE).astype(np.int64) + (hot >= FOUR)
        own = cap_of(n, percent)
        for cap in range(cap_of(max(1, least), percent), own + 1):
            k = np.minimum(wanted, cap)
            most = int(k.max())
            ends = [(most - 1) * (max(0, apart - rare) + 1) + 1 + missing - rare for apart, missing in ((max(apart_l, apart_s), larger), (apart_s, smaller))]
            end = min(len(pool), ends[0])
            for size in range(1, most + 1):
                at = np.flatnonzero(k[: max(0, end - size + 1)] == size)
                if len(at):
                    key = np.full(len(at), size + 8 * cap, np.uint64)
                    for i in range(size):
                        key = mix(key + pool[at + i])
                    keys.append(key)
                    small.append((at + size <= ends[1]) & (rare <= smaller) & (cap == own))
    return np.concatenate(keys), np.concatenate(small)


def _postings(width: int, percent: int, shared):
    def run(batches):
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held, size, first = [], 0, 0
            for i, s in enumerate(shingle_sets(texts, width)):
                held.append((*prefix_keys(s, levels, percent), len(s)))
                size += len(held[-1][0])
                if size >= 1 << 20 or i + 1 == len(texts):
                    counts = [len(k) for k, _, _ in held]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([k for k, _, _ in held]).view(np.int64)),
                            pa.array(np.repeat(np.array(nodes[first : i + 1], np.int64), counts)),
                            pa.array(np.concatenate([m for _, m, _ in held])),
                            pa.array(np.repeat(np.array([n for _, _, n in held], np.int32), counts)),
                        ],
                        names=["key", "node", "small", "n"],
                    )
                    held, size, first = [], 0, i + 1
        released()

    return run


def _verified(pairs: DataFrame, rows: int, reps: DataFrame, keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets reach the similarity. The texts of a go to those of b; sets are made on arrival."""
    few_pairs = maybe_broadcast(pairs, rows, 32)
    asked = few_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = reps.select("node", "key_id", "mark").join(maybe_broadcast(asked, 2 * rows, 16), "node")
    # Of repeated rows one is enough.
    texts = keyed.join(maybe_broadcast(found, 2 * rows, 40), ["key_id", "mark"]).select("node", "text").dropDuplicates(["node"])
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x")).join(few_pairs, "a")
    full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches):
        last, other = None, None
        for batch in batches:
            names, good = batch.column(1).to_pylist(), []
            for i, (b, s) in enumerate(zip(names, shingle_sets(batch.column(2).to_pylist(), width), strict=True)):
                if b != last:
                    last, other = b, next(iter(shingle_sets([batch.column(3)[i].as_py()], width)))
                both = len(np.intersect1d(s, other, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return written(few(full, rows, 512).mapInArrow(compare, "a long, b long"), "links")


def _words(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit words, folded to so many words; a link's distance stays a lower bound."""
    words = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    while words.shape[1] > size:
        words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
    return words


def _limit(total, percent: int):
    """Tokens outside either of two sets of so many tokens together that a link allows."""
    return total - 2 * (-(-percent * total // (100 + percent)))


def _apart(bits, one, two) -> np.ndarray:
    """Differing bits of the pairs (one, two), each compared at the length of its shorter bitmap."""
    sizes = np.array([len(b) // 8 for b in bits])
    out = np.zeros(len(one), np.int64)
    shapes = np.stack([sizes[one], sizes[two]], 1)
    for x, y in np.unique(shapes, axis=0):
        own = np.flatnonzero((shapes[:, 0] == x) & (shapes[:, 1] == y))
        step = max(1, (1 << 19) // max(x, y))
        for c in range(0, len(own), step):
            part = own[c : c + step]
            a, b = (_words([bits[i] for i in side[part]], min(x, y)) for side in (one, two))
            out[part] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return out


def _close(label, n, bits, percent: int):
    """(i, j, differing bits) arrays of one cell's pairs of different labels that lengths and bitmaps do not rule out."""
    order = np.argsort(n, kind="stable")
    label, n, bits = label[order], n[order], [bits[i] for i in order]
    short = np.empty((len(n), PARITY_BITS // 64), np.uint64)
    sizes = np.array([len(b) for b in bits])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for c in range(0, len(at), 1 << 10):
            short[at[c : c + (1 << 10)]] = _words([bits[i] for i in at[c : c + (1 << 10)]], PARITY_BITS // 64)
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    for c in range(0, len(n), 128):
        upto = int(ends[min(c + 128, len(n)) - 1])
        p, q = np.arange(c, min(c + 128, len(n))), np.arange(c + 1, upto)
        for d in range(0, len(q), 2048):
            other = q[d : d + 2048]
            i, j = np.nonzero((label[p][:, None] != label[other]) & (p[:, None] < other) & (other < ends[p][:, None]))
            if len(i) * 4 > len(p) * len(other):
                apart = np.bitwise_count(short[p][:, None, :] ^ short[other]).sum(2, dtype=np.int32)[i, j]
            else:
                apart = np.bitwise_count(short[p[i]] ^ short[other[j]]).sum(1, dtype=np.int32)
            one, two = p[i], other[j]
            near = apart <= _limit(n[one] + n[two], percent)
            one, two = one[near], two[near]
            if len(one):
                apart = _apart(bits, one, two)
                near = apart <= _limit(n[one] + n[two], percent)
                yield order[one[near]], order[two[near]], apart[near]


def _nearest(one, two, apart, most: int):
    """For each node of the pairs the partners that differ least, ties to the smaller one; and how many pairs neither side lists."""
    a, b, d = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([apart, apart])
    order = np.lexsort((b, d, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    kept = rank < most
    listed = np.zeros(len(one), np.int64)
    np.add.at(listed, order[kept] % len(one), 1)
    return a[kept], b[kept], d[order][kept], int((listed == 0).sum())


def _cells(percent: int, most: int):
    """Each node's nearest partners in each cell; rows arrive sorted by cell, which may span batches."""

    def run(batches):
        held: list[tuple] = []

        def compare():
            node, label, n = (np.array([r[i] for r in held], np.int64) for i in (1, 2, 3))
            found = list(_close(label, n, [r[4] for r in held], percent))
            if found:
                one, two, apart = (np.concatenate(c) for c in zip(*found, strict=True))
                if len(one):
                    a, b, d, left = _nearest(node[one], node[two], apart, most)
                    lefts = np.where(np.arange(len(a)) == 0, left, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, d, lefts)], names=["a", "b", "apart", "left"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield from compare()
                    held = []
                held.append(row)
        if held:
            yield from compare()

    return run


def _coarse(batches):
    """Bitmaps folded to about as many bits as the set has tokens: what cells compare before whole bitmaps do."""
    for batch in batches:
        short = []
        for n, bits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            size = PARITY_BITS // 64
            while 64 * size < n:
                size *= 2
            short.append(_words([bits], min(size, len(bits) // 8)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(short, pa.binary())], names=["node", "n", "bits"])


def _possible(pairs: DataFrame, rows: int, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b), rows of them, that lengths and parity bitmaps do not rule out; no link is lost."""
    sides = [reps.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b")]
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    one = sides[0].join(maybe_broadcast(pairs, rows, 32), "a")
    marked = sides[1].join(maybe_broadcast(one, rows, PARITY_MOST // 8), "b").filter(near).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if m:
                n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                apart = _apart(batch.column(4).to_pylist() + batch.column(5).to_pylist(), np.arange(m), np.arange(m) + m)
                yield batch.select(["a", "b"]).filter(pa.array(apart <= _limit(n, percent)))

    return written(few(marked, rows, 4096).mapInArrow(run, "a long, b long"), "possible", rows)


def gathered(known: DataFrame) -> DataFrame:
    """(cell, node, label): the postings known(key, node, label) of keys that hold several labels, by their smallest label, each node once.

    Nodes that share a key share its cell, so cells may take the keys' place in later rounds: every link still has one,
    and a node that shares hundreds of keys with a group of near copies has one row in it. Keys of one label get no
    other later, since labels only merge.
    """
    keys = known.groupBy("key").agg(F.min("label").alias("cell"), F.max("label").alias("last")).filter("cell < last").select("key", "cell")
    return known.join(keys, "key").select("cell", "node", "label").distinct()


def _across(placed: DataFrame, placed_n: int, nodes: DataFrame, nodes_bytes: int, percent: int, most: int) -> DataFrame:
    """(a, b, apart, left): nearest partners with other labels in the placed_n rows placed(cell, node, label), and how many pairs of a cell are in no list.

    Cells of many bytes are cut into bands of length, where partners are one band apart at most, and into blocks of
    nodes, of which every two meet.
    """
    rows = written(placed.join(maybe_broadcast(nodes.withColumn("cost", F.length("bits") + ROW_BYTES), 1, nodes_bytes), "node"), "cells", placed_n)
    sizes = rows.groupBy("cell").agg(F.sum("cost").alias("size"))
    found, most_bytes = sizes.agg(F.sum("size"), F.max("size")).first()
    dealt, cell = rows, F.col("cell")
    if (most_bytes or 0) > BLOCK_BYTES:
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
        bands = F.when(F.col("size").isNotNull(), F.array(band, band + 1)).otherwise(F.array(F.lit(-9)))
        banded = rows.join(sizes.filter(F.col("size") > BLOCK_BYTES), "cell", "left").withColumn("band", F.explode(bands)).drop("size")
        count = banded.groupBy("cell", "band").agg(F.ceil(F.sum("cost") / BLOCK_BYTES).cast("long").alias("count")).filter("count > 1")
        dealt = banded.join(count, ["cell", "band"], "left").withColumn("count", F.coalesce("count", F.lit(1).cast("long")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), "count")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
        cell = F.xxhash64("cell", "band", F.least("block", "other"), F.greatest("block", "other"))
    met = dealt.select(cell.alias("cell"), "node", "label", "n", "bits").repartition("cell").sortWithinPartitions("cell")
    return written(few(met, found or 0, BLOCK_BYTES).mapInArrow(_cells(percent, most), "a long, b long, apart long, left long"), "nearest")


def _text_sha(docs: DataFrame) -> Column:
    return F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text, ...)."""
    return _named_texts(docs.select("doc_id", "text", F.lit(None).cast("binary").alias("__sha")), width, percent).drop("text_sha")


def _named_texts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_components of docs(doc_id, text, __sha, ...), with __sha as text_sha: a doc_id may have several texts."""
    with small_batches(docs.sparkSession):
        return _joined_texts(docs, width, percent)


def _joined_texts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    # A text is found again by its doc_id and a hash of it: a doc_id, null too, may have many texts.
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__sha", mark.alias("mark"))
    whole = written(named.mapInArrow(_summaries(width), "block int, doc_id long, n long, digest binary, data binary, sha binary, mark long"), "summaries")
    members = whole.filter("block is null").select("doc_id", "n", "digest", "sha")
    counts = np.zeros((BLOCKS, (1 << BUCKET_BITS) // BLOCKS), np.uint64)
    blocks = whole.filter("block is not null").select("block", "data").repartition(BLOCKS, "block")
    for block, data in blocks.mapInArrow(_summed, "block int, data binary").collect():  # BLOCKS rows of fixed size
        counts[block] = np.frombuffer(data, np.uint64)
    levels = spark.sparkContext.broadcast(frequency_levels(counts.ravel()).tobytes())

    # One number for each class of equal sets; salted anew in the unlikely case that two share it.
    far = F.lit(2**63 - 1)
    salt = 0
    while True:
        classes = whole.filter("block is null and n > 0").groupBy(_node(F.col("digest"), salt).alias("node")).agg(
            F.min(F.struct(F.coalesce("doc_id", far).alias("key_id"), "mark")).alias("first"), F.min("digest").alias("digest"), F.max("digest").alias("last"), F.min("n").alias("n"), F.min("data").alias("bits")
        )
        reps = written(classes.select("node", "first.*", "digest", "n", "bits", (F.col("digest") != F.col("last")).alias("clash")), "classes")
        reps_n, clash = reps.agg(F.count(F.lit(1)), F.coalesce(F.max("clash"), F.lit(False))).first()
        if not clash:
            break
        discarded(reps)
        salt += 1

    keyed = named.select(F.coalesce("doc_id", far).alias("key_id"), "mark", "text")
    # Copies post nothing: only the text of a class's first document is indexed, once.
    first = maybe_broadcast(reps.select("node", "key_id", "mark"), reps_n, 40)
    posted = keyed.join(first, ["key_id", "mark"]).select("node", "text").mapInArrow(_postings(width, percent, levels), "key long, node long, small boolean, n int")
    postings = written(posted, "postings")
    # Most keys have one row; they go first, with as little as possible in motion.
    shared_keys = postings.groupBy("key").count().filter("count > 1").select("key")
    several = written(postings.join(shared_keys, "key"), "several")
    discarded(postings)
    # Every link has a key that its smaller set needs as such, and its larger set is no smaller.
    least = F.min(F.when(F.col("small"), F.col("n"))).alias("least")
    met = several.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), least, F.count(F.lit(1)).alias("rows"), F.min("n").alias("from"), F.max("n").alias("to"))
    met = met.filter(f"lead < last and least is not null and (rows > 2 or 100 * from >= {percent} * to)").select("key", "lead", "least")
    # A doc_id with several rows may post a key more than once; that does no harm.
    held = written(several.join(met, "key").filter("n >= least").select("key", "node", "lead"), "held")
    discarded(several)

    votes = held.filter("node != lead").groupBy("node", "lead").count().groupBy("node").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
    asked = written(votes.select(F.col("node").alias("a"), F.col("lead").alias("b")), "votes", reps_n)
    pairs = _possible(asked, asked.count(), reps, percent)
    links = _verified(pairs, pairs.count(), reps, keyed, width, percent)
    joined = written(components(links), "components")
    tried = asked

    # Rounds of nearest partners join what is left of groups; in the last one each pair left has been tried.
    nodes = held.select("node").distinct().join(reps.select("node", "n", "bits"), "node").select("node", "n", "bits")
    nodes = written(nodes.mapInArrow(_coarse, "node long, n long, bits binary"), "nodes", reps_n)
    nodes_bytes = nodes.agg(F.sum(F.length("bits") + 64)).first()[0] or 0
    most, left = 1, 1
    while left:
        held_n, joined_n = held.count(), joined.count()
        known = held.select("key", "node").join(maybe_broadcast(joined, joined_n, 32), "node", "left").withColumn("label", F.coalesce("label", "node"))
        placed = written(gathered(known), "placed", held_n)
        discarded(held)
        nearest = _across(placed, placed.count(), nodes, nodes_bytes, percent, most)
        left, listed = nearest.agg(F.sum("left" if most > 1 else F.lit(1)), F.count(F.lit(1))).first()
        best = nearest.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")) if most == 1 else nearest
        fresh_pairs = best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        old = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        pairs = written(fresh_pairs.join(old, ["a", "b"], "left_anti"), "pairs", listed)
        found, good = pairs.count(), 0
        if found:
            likely = _possible(pairs, found, reps, percent)
            more = _verified(likely, likely.count(), reps, keyed, width, percent)
            good = more.count()
            tried = tried.unionByName(pairs)
        if good:
            joined = written(merged(joined, more), "components", joined_n + 2 * good)
        # A node without any partner left in this round gets none later, since labels only merge.
        if left:
            asking = nearest.select(F.col("a").alias("node")).distinct()
            held = written(placed.select(F.col("cell").alias("key"), "node").join(maybe_broadcast(asking, listed, 16), "node", "left_semi"), "held", held_n)
        discarded(placed)
        # While half of the nearest partners are links, groups shrink by a constant share a round.
        if 2 * good < max(found, 1):
            most *= 8

    named = reps.select("node", "key_id").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("key_id").alias("component"))
    owner = written(named.join(least, "label").select("node", F.nullif("component", far).alias("component")), "owners", reps_n)
    return (
        members.withColumn("node", _node(F.col("digest"), salt))
        .join(maybe_broadcast(owner, reps_n, 32), "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.col("sha").alias("text_sha"))
    )


def keep_one_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that a smaller doc_id of their component stands for; same columns.

    Rows with the same doc_id as their component's smallest all stay, as do texts without shingles.
    """
    sha = fresh("sha", docs.columns)
    keyed = docs.withColumn(sha, _text_sha(docs))
    found = _named_texts(docs.select("doc_id", "text", _text_sha(docs).alias("__sha")), width, percent).filter("component_id < doc_id or doc_id is null and component_id is not null")
    gone = written(found.select(F.col("doc_id").alias("__gone"), F.col("text_sha").alias("__gone_sha")).distinct(), "gone")
    side = maybe_broadcast(gone, gone.count(), 64)
    return keyed.join(side, keyed["doc_id"].cast("long").eqNullSafe(side["__gone"]) & (keyed[sha] == side["__gone_sha"]), "left_anti").drop(sha)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), 3, 90)


#: All pairs that share a shingle, and the closure of their links: for small tables only.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u AS a JOIN u AS b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES = {"op1_ngram_join": SQL}
