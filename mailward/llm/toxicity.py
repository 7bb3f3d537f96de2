"""Toxicity by the nearest labelled examples (operator 12).

Terms are lower-cased words (runs of letters) and their prefixes of 4 to 6 letters, which stand for a word's
inflections. Those that are significantly tied to toxic examples make the vocabulary: a log-likelihood ratio
beyond the point that one of all terms would pass by chance, and LIFT times the share of toxic examples; where
fewer than FEWEST pass, the best ones that do so by themselves. Each text is reduced to its counts of these
terms, whole, once; document frequencies are counted over all documents. A vector has a weight
(1 + ln count) ln(1 + documents / frequency) for each term and length 1; all words without a term are one more
term, so one such word in a long text weighs less than many.

The labelled examples lie in an inverted index whose postings are cut into blocks of examples, each with the
largest weight of a term in it. For a text, the sums of these maxima bound the cosine of a block's examples;
blocks are read by falling bound until the k-th best cosine found exceeds the next bound. What is found are the
exact k nearest and all that tie with the last of them, so no order of the examples decides a vote.

A neighbour votes for its label with its cosine and for the labels' shares with the rest, and with the number
of labelled rows that it stands for, so a sample with as many rows of either label votes at the labelled rows'
shares. What a vote means is calibrated by isotonic regression on examples that neither the terms nor the
neighbours were taken from: one half of the sample under the other. A text without any term has no neighbours;
its score is the share of toxic rows among such examples. The nearest examples are the evidence of a score.

Training bound (documented parameters): per_class rows of each label, those with the smallest hashes of their
doc_id, of at most max_chars code points each. max_terms bounds the vocabulary. Everything else covers all
documents and whole texts.

Defined results. A null text counts as empty. A label other than 0 and null counts as 1; of several labels of
one doc_id the largest counts; labels of unknown documents count nothing but their share. Without toxic labels
every score is 0, with no other labels 1, without labels 0. Repeated rows are scored each; near copies of one
label are one example. A null doc_id is not held out, but cannot be labelled. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, released, table, written

PREFIXES = (4, 5, 6)
LIFT, FEWEST = 3.0, 8
#: Least log-likelihood ratio of any term: the chi-square of one degree that chance passes once in a hundred.
LEAST_RATIO = 6.6
NEIGHBOURS, BLOCK = 15, 32
#: Neighbours that the evidence of a score names.
SHOWN = 5
THRESHOLD = 0.3
#: Code points of a text that are split into words at once.
PIECE = 1 << 20
#: Words a worker remembers the terms of.
REMEMBERED = 1 << 18

#: The term that all words without a term of the vocabulary share; it sorts first.
REST = ""

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str):
    """Lists of a text's lower-cased words, some piece of the text at a time; no word is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end].isalpha():
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


def terms_of(word: str) -> list[str]:
    """The word itself, marked as whole, and its prefixes."""
    return [f"{word} ", *[word[:n] for n in PREFIXES if n <= len(word)]]


def term_counts(text: str) -> Counter:
    out: Counter = Counter()
    words: Counter = Counter()
    for part in words_of(text):
        words.update(part)
    for word, n in words.items():
        for term in terms_of(word):
            out[term] += n
    return out


def signature(text: str) -> tuple[int, ...]:
    """Smallest hashes of a text's words under three permutations; near copies mostly agree in all of them."""
    words = {w for part in words_of(text) for w in part}
    if not words:
        return ()
    hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint32)
    return tuple(int((hashes * np.uint32(m) ^ (hashes >> np.uint32(15))).min()) for m in (1, 2654435761, 2246822519))


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Twice the log of how much better two shares of examples with a term explain a and b than a common one."""

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    share = (a + b) / (toxic + clean)
    return 2 * (part(a, share * toxic) + part(b, share * clean) + part(toxic - a, (1 - share) * toxic) + part(clean - b, (1 - share) * clean))


def vocabulary_counts(text: str, numbers: dict[str, int], known: dict[str, list[int]]) -> dict[int, int]:
    """{term number: count} of a whole text; words without a term of the vocabulary count for REST. known: a memory of words."""
    out: Counter = Counter()
    for part in words_of(text):
        for word in part:
            if word not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = [numbers[t] for t in terms_of(word) if t in numbers] or [numbers[REST]]
            for t in known[word]:
                out[t] += 1
    return dict(sorted(out.items()))


def tied_terms(counts: list[Counter], labels: list[int], max_terms: int) -> list[str]:
    """The vocabulary: terms tied to label 1, by falling log-likelihood ratio, longer ones first, then by name.

    Of a word and its prefixes a term counts only if it is tied in the examples that hold none of the better ones.
    """
    toxic = sum(labels)
    clean = len(labels) - toxic
    if not toxic or not clean:
        return []
    inside, outside = Counter(), Counter()
    for own, y in zip(counts, labels, strict=True):
        (inside if y else outside).update(own.keys())
    names = sorted(inside)
    a, b = np.array([inside[t] for t in names], float), np.array([outside[t] for t in names], float)
    ratio = _likelihood_ratio(a, b, toxic, clean)
    # Beyond this a chi-square of one degree is met by chance once in a hundred vocabularies of this size.
    rare = 2 * np.log(100.0 * max(2, len(set(inside) | set(outside))))
    found = np.flatnonzero((a / toxic >= LIFT * (b / clean)) & (ratio > LEAST_RATIO)).tolist()
    order = [names[i] for i in sorted(found, key=lambda i: (-ratio[i], -len(names[i]), names[i]))]
    ratios = {names[i]: float(ratio[i]) for i in found}
    places: dict[str, set[int]] = {t: set() for t in order}
    for i, own in enumerate(counts):
        for t in own.keys() & places.keys():
            places[t].add(i)
    chosen: list[str] = []
    family: dict[str, list[str]] = {}
    for term in order:
        if len(chosen) >= max_terms or (ratios[term] <= rare and len(chosen) >= FEWEST):
            break
        kin = [k for k in family.get(term[:4], ()) if k.rstrip().startswith(term.rstrip()) or term.rstrip().startswith(k.rstrip())]
        rest = places[term].difference(*(places[k] for k in kin))
        own = sum(labels[i] for i in rest)
        left = float(_likelihood_ratio(np.array([own]), np.array([len(rest) - own]), toxic, clean)[0]) if rest else 0.0
        if left > LEAST_RATIO and own / toxic >= LIFT * (len(rest) - own) / clean:
            chosen.append(term)
            family.setdefault(term[:4], []).append(term)
    return chosen


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among unit vectors given as (term numbers, weights)."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.size, self.block = len(vectors), block
        self.blocks = -(-self.size // block)
        place = np.repeat(np.arange(self.size), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]).astype(np.int64) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((place, term))
        self.place, self.weight, term = place[order], weight[order], term[order]
        # A cell is a term's postings in one block of examples.
        cell = term * max(1, self.blocks) + self.place // block
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        self.start, self.stop = start, np.append(start[1:], len(cell))
        self.cell_block = self.place[start] // block
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.of_term = np.searchsorted(term[start] if len(start) else np.zeros(0, np.int64), np.arange(terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k examples of the largest cosine above 0 and of all that tie with the last, best first, then by place."""
        low, high = self.of_term[terms], self.of_term[terms + 1]
        cells = _ranges(low, high)
        asked = np.repeat(weights, high - low)
        bound = np.bincount(self.cell_block[cells], asked * self.most[cells], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        at, width = 0, 4
        while at < len(order) and bound[order[at]] > 0 and (len(best) < k or bound[order[at]] >= cosines[k - 1] - 1e-9):
            now = np.zeros(self.blocks, bool)
            now[order[at : at + width]] = True
            at, width = at + width, 2 * width
            own = now[self.cell_block[cells]]
            a, b = self.start[cells[own]], self.stop[cells[own]]
            posted = _ranges(a, b)
            sums = np.bincount(self.place[posted], np.repeat(asked[own], b - a) * self.weight[posted], minlength=self.size)
            found = np.flatnonzero(sums > 0)
            best, cosines = np.concatenate([best, found]), np.concatenate([cosines, sums[found]])
            # Rounding must not part ties: cosines are compared at twelve digits.
            rounded = np.round(cosines, 12)
            top = np.lexsort((best, -rounded))
            if len(top) > k:
                top = top[rounded[top] >= rounded[top[k - 1]]]
            best, cosines = best[top], cosines[top]
        return best, cosines


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0] - 1, low[1] .. high[1] - 1 and so on."""
    n = high - low
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - low, n)


def isotonic(values: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of the weighted least-squares rising step function, by pooling adjacent violators."""
    points, at = np.unique(values, return_inverse=True)
    mass = np.bincount(at, weights)
    mean = np.bincount(at, weights * targets) / mass
    pools: list[list[float]] = []
    for x, y, w in zip(points.tolist(), mean.tolist(), mass.tolist(), strict=True):
        pools.append([y, w, x, x])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            y2, w2, _, right = pools.pop()
            y1, w1, left, _ = pools.pop()
            pools.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, left, right])
    return np.array([e for p in pools for e in (p[2], p[3])]), np.array([e for p in pools for e in (p[0], p[0])])


@dataclass
class ToxicityModel:
    """Weights of term numbers (0 for others' terms), the examples in the order of the index, and what votes mean."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    index: BlockMaxIndex | None
    prior: float
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    blank: float = 0.0

    def vector(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text and their weights, of length 1 together; empty if only REST is left."""
        t, n = np.array(terms, np.int64), np.array(counts, float)
        own = self.idf[t] > 0 if (self.idf[t[t > 0]] > 0).any() else np.zeros(len(t), bool)
        t = t[own]
        w = (1 + np.log(n[own])) * self.idf[t]
        return t, w / max(1e-300, float(np.sqrt((w * w).sum())))

    def vote(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[float | None, np.ndarray, np.ndarray]:
        """(share of label 1, places, cosines); a neighbour votes with its cosine, what is left of it with the prior. None without any."""
        if self.index is None or not len(terms):
            return None, np.zeros(0, np.int64), np.zeros(0)
        places, cosines = self.index.nearest(terms, weights, k)
        if not len(places):
            return None, places, cosines
        cast, near = self.votes[places], np.minimum(cosines, 1.0)
        return float((cast * (near * self.labels[places] + (1 - near) * self.prior)).sum() / cast.sum()), places, cosines

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        """Calibrated score and evidence of one text's counts of vocabulary terms."""
        share, places, cosines = self.vote(*self.vector(terms, counts)) if terms else (None, (), ())
        if share is None:
            return self.blank, []
        shown = [{"doc_id": int(self.ids[p]), "toxic": int(self.labels[p]), "cosine": float(c)} for p, c in zip(places[:SHOWN].tolist(), cosines[:SHOWN].tolist(), strict=True)]
        return min(1.0, max(0.0, float(np.interp(share, *self.knots)))), shown


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> tuple[list, dict[int, int]]:
    """(doc_id, text, label, half) of the bounded training rows, and how many labelled rows each label has.

    Near copies of one label, by signature, are one row; those of different labels are in the same half.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("label"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    counts = {r["label"]: int(r["count"]) for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], {}
    bound = F.lit(0).cast("long")
    for label, n in counts.items():
        bound = F.when(F.col("label") == label, F.lit(min(1 << 40, int((1 << 40) * 1.2 * per_class / n) + 1))).otherwise(bound)
    # Some 1.2 per_class rows of each label, so the side is bounded by a parameter.
    taken = F.broadcast(known.filter(F.col("h") < bound).orderBy("h").limit(int(2.6 * per_class)).select("doc_id", "label", "h"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= max_chars)
    found = texts.join(taken, "doc_id").orderBy("h", "text").limit(int(2.6 * per_class)).collect()
    held: Counter = Counter()
    rows, seen = [], set()
    for r in found:
        own = signature(r.text)
        if (own, r.label) not in seen and held[r.label] < per_class:
            seen.add((own, r.label))
            held[r.label] += 1
            rows.append((r.doc_id, r.text, r.label, (own[0] >> 7) & 1 if own else len(rows) & 1))
    return rows, counts


def counted_terms(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, terms, counts: the vocabulary terms of every whole text, by term number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        numbers, known = shared.value, {}

        for batch in pieces(batches):
            terms, counts = [], []
            for text in batch.column(1).to_pylist():
                own = vocabulary_counts(text or "", numbers, known)
                terms.append(list(own))
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, terms array<int>, counts array<bigint>")


@dataclass(frozen=True)
class Vocabularies:
    """Terms chosen on all examples and on each of two halves; numbers covers all of them."""

    whole: list[str]
    halves: tuple[list[str], list[str]]

    @property
    def numbers(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(sorted({REST, *self.whole, *self.halves[0], *self.halves[1]}))}


def vocabularies(rows: list, max_terms: int) -> tuple[Vocabularies, list[tuple[int, dict[int, int], int, int]]]:
    """Vocabularies of sample rows (doc_id, text, label, half), and the rows with {term number: count} for their text."""
    counts = [term_counts(t) for _, t, *_ in rows]

    def tied(kept):
        return tied_terms([c for c, r in zip(counts, rows, strict=True) if r[3] in kept], [r[2] for r in rows if r[3] in kept], max_terms)

    found = Vocabularies(tied((0, 1)), (tied((0,)), tied((1,))))
    numbers = found.numbers
    known: dict[str, list[int]] = {}
    return found, [(key, vocabulary_counts(text, numbers, known), y, half) for key, text, y, half in rows]


def indexed(rows: list, counts: dict[int, int], idf: np.ndarray) -> ToxicityModel:
    """An index of the rows' vectors; a row stands for its share of the labelled rows of its label. Not calibrated."""
    sampled = Counter(r[2] for r in rows)
    model = ToxicityModel(idf, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), None, counts.get(1, 0) / max(1, sum(counts.values())))
    held = [(*model.vector(list(own), list(own.values())), key, y) for key, own, y, _ in rows]
    # Examples with the same heaviest terms stand together, so that few blocks reach a text's bound.
    held = sorted((e for e in held if len(e[0])), key=lambda e: (e[0][np.argsort(-e[1], kind="stable")[:3]].tolist(), e[2]))
    if held:
        model.ids, model.labels = np.array([e[2] for e in held], np.int64), np.array([e[3] for e in held], float)
        model.votes = np.array([counts[e[3]] / sampled[e[3]] for e in held])
        model.index = BlockMaxIndex([(t, w) for t, w, *_ in held], len(idf))
    return model


def fit_toxicity(rows: list, counts: dict[int, int], chosen: Vocabularies, frequencies: dict[int, int], documents: int) -> ToxicityModel:
    """The model of sample rows (doc_id, {term number: count}, label, half), given document frequencies over all documents.

    What a vote means is read from each half of the rows under terms and examples of the other half.
    """
    numbers = chosen.numbers

    def idf(terms: list[str]) -> np.ndarray:
        out = np.zeros(len(numbers))
        for t in (REST, *terms):
            out[numbers[t]] = np.log1p(documents / max(1, frequencies.get(numbers[t], 0)))
        return out

    model = indexed(rows, counts, idf(chosen.whole))
    if {r[2] for r in rows} != {0, 1}:
        model.index, model.blank = None, model.prior
        return model
    stands = {y: counts[y] / n for y, n in Counter(r[2] for r in rows).items()}
    shares, targets, masses = [], [], []
    blank = {0: 0.5, 1: 0.5 * model.prior}
    for half, terms in enumerate(chosen.halves):
        other = indexed([r for r in rows if r[3] == half], counts, idf(terms))
        for _, own, y, _ in (r for r in rows if r[3] != half):
            share = other.vote(*other.vector(list(own), list(own.values())))[0]
            if share is None:
                blank[y] += stands[y]
            else:
                shares.append(share)
                targets.append(y)
                masses.append(stands[y])
    model.blank = blank[1] / (blank[0] + blank[1])
    if shares:
        model.knots = isotonic(np.array(shares), np.array(targets, float), np.array(masses))
    return model


EVIDENCE = "array<struct<doc_id:bigint,toxic:int,cosine:double>>"


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_chars: int = 20_000, max_terms: int = 1 << 14) -> DataFrame:
    """doc_id, score and evidence (the SHOWN nearest examples, best first) of every row of docs(doc_id, text)."""
    rows, counts = labelled_sample(docs, labels, per_class, max_chars)
    chosen, examples = vocabularies(rows, max_terms)
    held = written(counted_terms(docs, chosen.numbers), "terms")
    # One row a vocabulary term.
    frequencies = {r["term"]: int(r["count"]) for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(examples, counts, chosen, frequencies, held.count()))
    inner = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in pieces(batches, 4096):
            found = [model.score(t, c) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], inner)], names=["doc_id", "score", "evidence"])
        released()

    return held.mapInArrow(run, f"doc_id long, score double, evidence {EVIDENCE}")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
