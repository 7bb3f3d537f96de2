"""Byte-pair encoding and decoding (operator 6).

``Merger`` encodes one pre-token: symbols form a doubly linked list, candidate merges wait in a
priority queue by (rank, position), and entries whose symbols have changed meanwhile are skipped.
``WordCodec`` adds what the vocabulary file prescribes around it: special tokens, normalisation,
splitting and bytes as letters. White space only separates, so a text is the sequence of its
white-space-free chunks, and a worker remembers the chunks that it has met.

Defined results. A null text counts as empty and has no tokens; the digests are those of the empty
string. Rows are independent, so repeats and ties need no rule. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

#: Chunks and pre-tokens that a worker remembers; later ones are encoded each time they come.
REMEMBERED = 300_000

_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_pattern(path: str) -> regex.Pattern:
    """The pattern of a vocabulary file for the words of normalised text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return regex.compile(split["pattern"]["Regex"])


def byte_letters() -> dict[int, str]:
    """Each byte as one printable letter: itself where it is printable, else a letter from 256 upwards."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)}


def split_chunks(text: str) -> list[str]:
    """The chunks of a text between white space as Unicode defines it."""
    if _ODD_SPACE.search(text):  # str.split() also splits at these four, which are no white space
        return [c for c in _SPACE.split(text) if c]
    return text.split()


class Merger:
    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])

    def encode(self, symbols: list[str]) -> list[int]:
        ids = [self.vocab[s] for s in symbols]
        n = len(ids)
        if n < 2:
            return ids
        pairs = self.pairs
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = pairs.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, left, right, made = pop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged since
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get((made, ids[k]))
                if found:
                    push(queue, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get((ids[h], made))
                if found:
                    push(queue, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]


class WordCodec:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merger = Merger(model["vocab"], model["merges"])
        self.suffix = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.parts = regex.compile(split["pattern"]["Regex"])
        self.letters = byte_letters()
        self.remembered = remembered
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, int] = {}
        self.lengths: dict[str, int] = {}
        self.ids: list[str] = []
        self.texts: list[str] = []

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            letters = self.letters
            symbols = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.suffix
            found = tuple(self.merger.encode(symbols))
            if len(self.words) < self.remembered:
                self.words[word] = found
        return found

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a piece of text without white space."""
        out: list[int] = []
        for piece in self.specials.split(chunk) if "<|" in chunk else (chunk,):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                if not piece.isascii():
                    # Lower-casing goes letter by letter: no form of sigma depends on its neighbours.
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                for word in self.parts.findall(piece.lower()):
                    out.extend(self._word(word))
        return out

    def _rendered(self, chunk: str) -> tuple[str, str]:
        ids = self.chunk_ids(chunk)
        return " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def encode(self, text: str | None) -> list[int]:
        return [i for c in split_chunks(text or "") for i in self.chunk_ids(c)]

    def count(self, text: str | None) -> int:
        """How many ids the whole text has; of chunks it remembers only that number, and a tenth as many words."""
        lengths, n = self.lengths, 0
        for c in split_chunks(text or ""):
            size = lengths.get(c)
            if size is None:
                if len(self.words) > self.remembered // 10:
                    self.words.clear()
                size = len(self.chunk_ids(c))
                if len(lengths) < self.remembered // 2:
                    lengths[c] = size
            n += size
        return n

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, joined as the library does for a file that names no decoder."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def rendered(self, text: str | None) -> tuple[str, str]:
        """(decimal ids joined by a space, decoded text) of the whole text."""
        chunks, ids, texts = self.chunks, [], []
        for c in split_chunks(text or ""):
            at = chunks.get(c)
            if at is None:
                a, b = self._rendered(c)
                if len(chunks) < self.remembered:
                    chunks[c] = len(self.ids)
                    self.ids.append(a)
                    self.texts.append(b)
            else:
                a, b = self.ids[at], self.texts[at]
            if a:
                ids.append(a)
                texts.append(b)
        return " ".join(ids), " ".join(texts)


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec a worker process."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""

    def run(batches):
        own = codec(path)
        for batch in pieces(batches):
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                a, b = own.rendered(text)
                counts.append(a.count(" ") + 1 if a else 0)
                ids.append(hashlib.sha256(a.encode()).hexdigest())
                texts.append(hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of encoded(doc_id, ids)."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
