"""Token-ID files: length-delimited binary records with an offset index (operator 10).

Texts are dealt by ranges of doc_id, sorted, encoded and written one shard a task, so that shard after
shard holds the documents in ascending doc_id order. A record is

    length of the payload   8 bytes, little-endian
    masked CRC of these     4 bytes
    payload                 doc_id (8 bytes), bytes an id (1), ids (2 or 4 bytes each, little-endian)
    masked CRC of it        4 bytes

where a masked CRC is the CRC-32 rotated right by 15 bits plus 0xA282EAD8, so that a CRC of data that
hold CRCs stays useful. Beside each shard lies an index of 24 bytes a record (doc_id, offset, ids) for
shuffled reads. A task writes under a name of its own; only names that reach the manifest count, so a
repeated or lost task leaves nothing wrong behind.

Defined results. A null text counts as empty: its record holds the end id alone. Of rows with the same
doc_id the order is by their text's hash, then text. A null doc_id comes first and is written as the
smallest long. An empty table makes no shard. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written
from .wordbpe import REMEMBERED, split_chunks, split_pattern, vocabulary_path

END_ID = 2
_LENGTH, _CRC, _HEAD, _INDEX = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB"), struct.Struct("<qQQ")
_NO_ID = -(2**63)
#: Code points of text that are split and encoded at once.
GROUP_CHARS = 1 << 20
#: Characters that are normalised each by itself and that every version of Unicode takes alike: ASCII, Latin letters, dashes and quotes.
_CHARS = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u2010-\u2027"
_PLAIN, _PLAIN_TEXT = (re.compile(f"[{more}{_CHARS}]+").fullmatch for more in ("", "\t-\r "))
#: Stands between plain chunks as a word of its own, and between their ids, which have 17 bits at most.
_BETWEEN, _NO_IDS = "\0", b"\xff" * 4


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray) -> bytes:
    """One record; ids narrower than 16 bits take two bytes each."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = _HEAD.pack(doc_id, width) + ids.astype(f"<u{width}").tobytes()
    size = _LENGTH.pack(len(payload))
    return size + _CRC.pack(masked_crc(size)) + payload + _CRC.pack(masked_crc(payload))


def index_entry(doc_id: int, offset: int, ids: int) -> bytes:
    return _INDEX.pack(doc_id, offset, ids)


def read_record(file) -> tuple[int, np.ndarray] | None:
    """(doc_id, ids) of the next record; None at the end. Raises ValueError on damage."""
    size = file.read(12)
    if not size:
        return None
    if len(size) < 12 or _CRC.unpack_from(size, 8)[0] != masked_crc(size[:8]):
        raise ValueError("damaged record length")
    n = _LENGTH.unpack_from(size)[0]
    body = file.read(n + 4)
    if len(body) < n + 4 or _CRC.unpack_from(body, n)[0] != masked_crc(body[:n]):
        raise ValueError("damaged record")
    doc_id, width = _HEAD.unpack_from(body)
    return doc_id, np.frombuffer(body, f"<u{width}", (n - _HEAD.size) // width, _HEAD.size)


def read_at(shard: str, index: str, position: int) -> tuple[int, np.ndarray]:
    """The record at a position of a shard, found through its index."""
    with _opened(index, "r") as file:
        file.seek(position * _INDEX.size)
        _, offset, _ = _INDEX.unpack(file.read(_INDEX.size))
    with _opened(shard, "r") as file:
        file.seek(offset)
        return read_record(file)


def _opened(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


class LibraryEncoder:
    """The tokenizers library, asked once for each chunk of text between white space, or each word of plain chunks, that is met often.

    A chunk of plain letters and signs has the ids of its lower-cased words, one word after the other, so of such chunks
    the library encodes only words not met before, many at once and without normalising. All other chunks go to it whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.parts = split_pattern(path)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks of any characters."""
        out = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[c] = np.array(e.ids, "<u4").tobytes()
        return out

    def _worded(self, new: list[str]) -> dict[str, bytes]:
        """Ids of lower-cased words of plain chunks; each ends with the only one of its ids that may end a word."""
        out = {}
        for at in range(0, len(new), 100):
            part = new[at : at + 100]
            (found,) = self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends, data = (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), ids.tobytes()
            out.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        return out

    def _fresh(self, new: set[str]) -> dict[str, bytes]:
        """Ids of chunks not met before."""
        plain = [c for c in new if _PLAIN(c) and "<|" not in c]
        out = self._whole(list(new.difference(plain)))
        if plain:
            words, known = self.parts.findall(f" {_BETWEEN} ".join(plain).lower()), self.words
            ids = list(map(known.get, words))
            asked = self._worded(list({w for w, x in zip(words, ids, strict=True) if x is None} - {_BETWEEN}))
            look = asked | {_BETWEEN: _NO_IDS}
            out.update(zip(plain, b"".join([look[w] if x is None else x for w, x in zip(words, ids, strict=True)]).split(_NO_IDS), strict=True))
            if len(known) < self.remembered:
                known.update(asked)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id behind them."""
        known, split, missing = self.known, [], set()
        for t in texts:
            if t and _PLAIN_TEXT(t) and "<|" not in t:
                t = t.lower()
            chunks = split_chunks(t or "")
            ids = list(map(known.get, chunks))
            gaps = [i for i, x in enumerate(ids) if x is None]
            missing.update([chunks[i] for i in gaps])
            split.append((chunks, ids, gaps))
        fresh, end, out = self._fresh(missing), np.array([END_ID], "<u4").tobytes(), []
        for chunks, ids, gaps in split:
            for i in gaps:
                ids[i] = fresh[chunks[i]]
            ids.append(end)
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        if len(known) < self.remembered:
            known.update(fresh)
        return out


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def _grouped(texts: list[str | None]):
    """Slices of about GROUP_CHARS code points."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


MANIFEST = "shard int, file string, records long, ids long"


def write_records(docs: DataFrame, folder: str, path: str, partitions: int | None = None) -> DataFrame:
    """Write the shards below folder (a URI); returns the manifest, one row a shard, from durable files."""
    tie = F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")

    def write(batches):
        encoder, shard = _encoder(path), TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        out = index = None
        offset = records = total = 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if out is None and keys:
                out, index = _opened(f"{name}.tok", "w"), _opened(f"{name}.idx", "w")
            for a, b in _grouped(texts):
                for key, ids in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True):
                    data = frame(_NO_ID if key is None else key, ids)
                    out.write(data)
                    index.write(index_entry(_NO_ID if key is None else key, offset, len(ids)))
                    offset, records, total = offset + len(data), records + 1, total + len(ids)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([records], pa.int64()), pa.array([total], pa.int64())], names=["shard", "file", "records", "ids"])

    return written(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, each shard read as a stream."""
    spark = manifest.sparkSession
    shards = sorted(manifest.select("shard", "file", "ids").collect())  # a row a shard, not a document
    starts, before = [], 0
    for shard, file, ids in shards:
        starts.append((shard, file, before))
        before += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame(starts, "shard int, file string, start long")
    if starts:
        listed = listed.repartitionByRange(len(starts), "shard")

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = []
                with _opened(f"{file}.tok", "r") as raw, pa.BufferedInputStream(raw, 1 << 20) as stream:
                    while (record := read_record(stream)) is not None:
                        key, ids = record
                        rows.append((None if key == _NO_ID else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return listed.mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/mailward/tokens-{uuid.uuid4().hex}"
    return read_records(write_records(table(spark, sf_dir, "documents"), folder, vocabulary_path()))


QUERIES = {"op10_token_records": op10_token_records}
ORACLES: dict[str, str] = {}
