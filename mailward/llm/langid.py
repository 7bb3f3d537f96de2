"""Language identification by averaged hashed subword embeddings (operator 7).

A text becomes its lower-cased bytes with everything but letters turned into one boundary byte. Each
run of 2, 3 and 4 bytes that has no boundary inside (one may open or close it) is a subword; its hash
picks a row of an embedding matrix, the rows are averaged, and a linear softmax turns the average into
probabilities. Embeddings and softmax are trained together by stochastic gradient descent in numpy.
As everything up to the softmax is linear, prediction sums one row of class logits for each subword.

A temperature and two limits of rejection are calibrated on labelled rows that were kept out of the descent.
One lies below the scores of rows classified rightly. The other is of the share of a text's subwords that the
descent has met: rows kept out show what it is for learned languages, and the same rows measured by the
subwords of all other labels show what it is for a language that was not learned; the limit lies between the
two. Of a short text the share is read with its error, so few unknown subwords reject nothing.

Training bound (documented parameters): at most ``per_class`` documents a label, those with the
smallest hashes of their doc_id, of at most ``max_chars`` code points each, and of the ``max_classes``
commonest labels (all of them by default). Prediction always reads the whole text.

Defined results. ``und`` with score 0 for a null text or one without letters. Without any labelled
row, every document is ``und``. Extra columns pass through or are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, pieces, table

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Parts of rightly classified rows that may lie below a limit, and of foreign ones that may lie above.
LOST, PASSED = 0.001, 0.1
UNKNOWN = "und"
CHUNK = 1 << 18

_EDGE = 0x20
_FOLD = np.full(256, _EDGE, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def _subwords(raw: np.ndarray, most: int | None = None):
    """For each order, (positions, buckets) of the subwords of the folded bytes; only of those that start among the first most."""
    b = _FOLD[raw]
    edge = b == _EDGE
    for n in ORDERS:
        if len(b) < n:
            continue
        m = len(b) - n + 1 if most is None else min(len(b) - n + 1, most)
        key = np.full(m, n, np.uint32)
        for i in range(n):
            key *= np.uint32(0x01000193)
            key ^= b[i : i + m]
        key *= np.uint32(2654435761)
        inner = np.zeros(m, bool)
        for i in range(1, n - 1):
            inner |= edge[i : i + m]
        inner |= edge[:m] & edge[n - 1 : n - 1 + m] if n == 2 else False
        at = np.flatnonzero(~inner)
        yield at, (key[at] >> np.uint32(16)).astype(np.int64)


@dataclass
class LanguageModel:
    """classes, the embeddings already multiplied by the softmax weights, bias, temperature, threshold."""

    classes: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    met: np.ndarray | None = None
    least_known: float = 0.0

    def scores(self, buffer: bytes) -> np.ndarray:
        """Mean class logits of one text's UTF-8 bytes."""
        return self.measured(buffer)[0]

    def measured(self, buffer: bytes) -> tuple[np.ndarray, float, int]:
        """Mean class logits, share of subwords that were met in training, and subwords; piece by piece so that memory stays bounded."""
        total, count, known = np.zeros(len(self.classes)), 0, 0
        raw = np.frombuffer(buffer, np.uint8)
        for start in range(0, max(1, len(raw)), CHUNK):
            # Subwords that start in this piece may end in the next one.
            for _, buckets in _subwords(raw[start : start + CHUNK + max(ORDERS) - 1], CHUNK):
                total += self.logits.T @ np.bincount(buckets, minlength=BUCKETS) if len(buckets) > 4 * BUCKETS else self.logits[buckets].sum(0, dtype=np.float64)
                count += len(buckets)
                known += len(buckets) if self.met is None else int(self.met[buckets].sum())
        return total / max(1, count) + self.bias, known / max(1, count), count

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Names, scores and whether each text is rejected."""
        names, scores, rejected = [], [], []
        for text in texts:
            if not self.classes or not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(True)
                continue
            z, known, count = self.measured(text.encode("utf-8", "surrogatepass"))
            z = z * self.temperature
            p = np.exp(z - z.max())
            k = int(np.argmax(p))
            names.append(self.classes[k])
            scores.append(float(p[k] / p.sum()))
            rejected.append(scores[-1] < self.threshold or known + _margin(count) < self.least_known)
        return names, scores, rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]


def _margin(count: int) -> float:
    """One standard error, at most, of a share of so many subwords."""
    return 0.5 / max(1, count) ** 0.5


def _bags(text: str, span: int = 1500):
    """(buckets, weights) of the whole text and of its parts, so that short texts are learned too."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    parts = [raw] + ([raw[i : i + span] for i in range(0, len(raw), span)] if len(raw) > span else [])
    for part in parts:
        found = [b for _, b in _subwords(part)]
        if found and sum(map(len, found)):
            buckets, counts = np.unique(np.concatenate(found), return_counts=True)
            yield buckets, (counts / counts.sum()).astype(np.float32)


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.6, seed: int = 7) -> LanguageModel:
    """SGD on three quarters of the rows; the rest calibrates temperature and threshold."""
    rows = [(t, y) for t, y in zip(texts, labels, strict=True) if has_letter(t) and y is not None]
    classes = sorted({y for _, y in rows})
    if not classes:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    of = {y: k for k, y in enumerate(classes)}
    fit = [r for i, r in enumerate(rows) if i % 4] or rows
    held = [r for i, r in enumerate(rows) if not i % 4] or rows
    bags = [(b, w, of[y]) for t, y in fit for b, w in _bags(t)]
    rng = np.random.default_rng(seed)
    table_, weights, bias = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32), np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    weights += rng.normal(0, 0.1, weights.shape)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            buckets, share, y = bags[i]
            lr = rate * (1 - done / steps)
            hidden = share @ table_[buckets]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights @ p
            weights -= lr * np.outer(hidden, p)
            bias -= lr * p
            # A bag's gradient is spread over its subwords by their share; rescaled so that rare rows move.
            table_[buckets] -= (lr * 20) * np.outer(share, back)
            done += 1
    model = LanguageModel(classes, (table_ @ weights).astype(np.float32), bias.astype(np.float64))
    z = np.array([model.scores(t.encode("utf-8", "surrogatepass")) for t, _ in held])
    y = np.array([of[v] for _, v in held])

    def loss(t):
        s = z * t
        top = s.max(1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(len(y)), y]).mean())

    model.temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
    p = np.exp(z * model.temperature - (z * model.temperature).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == y
    if right.any():
        model.threshold = 0.9 * float(np.quantile(p.max(1)[right], LOST))
    met = np.zeros((len(classes), BUCKETS), bool)
    for b, _, k in bags:
        met[k, b] = True
    model.met = met.any(0)
    model.least_known = _limit(model, met, held, of)
    return model


def _limit(model: LanguageModel, met: np.ndarray, held: list, of: dict[str, int]) -> float:
    """The share of known subwords between that of learned languages and that of the same rows under all other labels."""
    own, foreign = [], []
    others = [np.delete(met, k, 0).any(0) for k in range(len(met))]
    for text, label in held:
        found = [b for _, b in _subwords(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))]
        buckets = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(buckets):
            own.append(float(model.met[buckets].mean()) + _margin(len(buckets)))
            foreign.append(float(others[of[label]][buckets].mean()) + _margin(len(buckets)))
    if not own:
        return 0.0
    low, high = float(np.quantile(own, LOST)), float(np.quantile(foreign, 1 - PASSED))
    # Where the two overlap no limit can part them: then it lies as far below the learned rows as these lie below 1.
    return (low + high) / 2 if high < low else max(0.0, 2 * low - 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_class: int = 250, max_chars: int = 20_000, max_classes: int | None = None) -> LanguageModel:
    """Learn from text and lang of the labelled rows that are not held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= max_chars))
    labelled = labelled.select("text", "lang", (F.xxhash64("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).alias("h"))
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = (common if max_classes is None else common.limit(max_classes)).collect()  # a row a label
    if not counts:
        return train([], [])
    # Each label keeps the rows under its own hash bound, about per_class of them.
    bound = F.lit(None).cast("decimal(20,0)")
    for r in counts:
        share = min(1.0, 1.2 * per_class / r["count"])
        bound = F.when(F.col("lang") == r["lang"], F.lit(str(int(share * 2**64))).cast("decimal(20,0)")).otherwise(bound)
    sample = labelled.filter(F.col("h") < bound).orderBy("h", "text").limit(2 * per_class * len(counts)).collect()
    taken: dict[str, int] = {}
    rows = []
    for r in sample:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_class:
            rows.append((r["text"], r["lang"]))
    return train([t for t, _ in rows], [y for _, y in rows])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and rejected (beyond a calibrated limit, or ``und``) added; columns called so, in any case of letters, give way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "lang_pred string, score double, rejected boolean"
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")])

    def run(batches):
        m = shared.value
        for batch in pieces(batches):
            names, scores, rejected = m.judge(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    from pyspark.sql import types as T

    out = T.StructType([*docs.schema.fields, *T._parse_datatype_string(schema).fields])
    return docs.mapInArrow(run, out)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language the model fitted on docs does not reject; same columns with the same values, whatever they are called."""
    made = ("lang_pred", "score", "rejected")
    taken = list(docs.columns)
    aside = {}
    for c in docs.columns:
        if c.lower() in made:
            aside[c] = fresh(f"own_{c}", [*taken, *aside.values()])
    found = predict(docs.withColumnsRenamed(aside), fit(docs)).filter("not rejected")
    return found.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
