"""Packing documents into token sequences along a space-filling curve.

Every text becomes token ids and an end id. Its hashed token counts are projected to a few dimensions, and the cell
of the projection gives a key on a Hilbert curve, so that documents with close keys are alike. Sorted by key, the
documents follow each other without gaps, and every LENGTH ids are a sequence: only what is left at the very end is
shorter, and it is cut into sequences whose lengths are powers of two, which need no padding.

The curve is sorted as narrow rows by range; each range adds up its lengths, and only one total per range meets on
the driver. Ids travel once, to meet the place of their document.

A null text is an empty one: its document is its end id. Repeated rows are documents of their own. An empty table
gives no pieces. Ties on the curve are broken by row. Other columns are not read.
"""

from __future__ import annotations

import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Tokenizer

from pairloom.llm.tables import stage
from pairloom.llm.words import blocks, span_hashes

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 1024
END_ID = 0
BUCKETS = 256  # of the hashed document vector
DIMENSIONS = 4
BITS = 8  # of each dimension
MOST_CHUNKS = 1 << 21  # remembered chunks of text; beyond, a worker starts anew

_rng = np.random.default_rng(7)
RAW_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PROJECTION = _rng.standard_normal((BUCKETS, DIMENSIONS))


class Encoder:
    """Token ids of many texts at once.

    Byte-level BPE never joins what stands before white space with the white space, so a text is encoded chunk by
    chunk: white space and what follows up to the next white space. Chunks repeat, so each is encoded once.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32  # of remembered ids
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # ascending
        self.slots = np.zeros(0, np.int32)
        self.cuts = np.zeros(1, np.int64)  # of the chunks in ids, by slot
        self.ids = np.zeros(0, self.kind)

    def _chunks(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of chunks. A chunk starts at a text, and at a space or line break after a byte that surely ends
        no white space: printable ASCII, or the second byte of a character from U+00C0 to U+00FF."""
        if not len(data):
            return np.zeros(0, np.int64)
        blank = (data == 32) | (data == 10)
        solid = (data > 32) & (data < 127)
        solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        start = np.zeros(len(data), bool)
        start[1:] = blank[1:] & solid[:-1]
        start[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        return np.flatnonzero(start)

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        encode, lengths, learnt = self.tokenizer.encode, [], array(self.kind().dtype.char)
        for chunk in chunks:  # one by one: a result is many times larger than its ids, and threads keep memory of their own
            ids = encode(chunk, add_special_tokens=False).ids
            lengths.append(len(ids))
            learnt.extend(ids)
        at = np.searchsorted(self.hashes, hashes)
        new = np.arange(len(self.slots), len(self.slots) + len(hashes), dtype=np.int32)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, new)
        self.cuts = np.concatenate([self.cuts, np.cumsum(lengths) + len(self.ids)])
        self.ids = np.concatenate([self.ids, np.frombuffer(learnt, self.kind)])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, each with its end id, and the n + 1 bounds of the texts in ids."""
        starts = self._chunks(data, bounds)
        n_texts = len(bounds) - 1
        ends = np.append(starts[1:], len(data))
        distinct, first, inverse = np.unique(
            span_hashes(data, starts, ends, RAW_CODES), return_index=True, return_inverse=True
        )
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            if len(self.hashes) > MOST_CHUNKS:
                self.forget()
                known[:] = False
            new = first[~known]
            raw = data.tobytes()
            self._learn(distinct[~known], [raw[a:b].decode() for a, b in zip(starts[new], ends[new], strict=True)])
        slots = self.slots[np.searchsorted(self.hashes, distinct)][inverse]
        lengths = self.cuts[slots + 1] - self.cuts[slots]
        before = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat(self.cuts[slots] - before[:-1], lengths) + np.arange(before[-1])
        text_bounds = before[np.searchsorted(starts, bounds)]
        text_of = np.repeat(np.arange(n_texts), np.diff(text_bounds))
        out = np.full(before[-1] + n_texts, END_ID, np.uint32)
        out[np.arange(before[-1]) + text_of] = self.ids[source]
        return out, text_bounds + np.arange(n_texts + 1)


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which is used by one task after another."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def document_points(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Cell coordinates of the projected token counts of every document, BITS bits each."""
    n = len(bounds) - 1
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(16)) % np.uint64(BUCKETS)
    text_of = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(text_of * BUCKETS + bucket.astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    vectors = np.log1p(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return np.clip((0.5 + 0.5 * np.tanh(vectors @ PROJECTION)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point on the Hilbert curve through the grid of ``bits`` bits per dimension."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations of the sub-cubes, largest first
        low = level - 1
        for i in range(n):
            up = (x[i] & level) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[n - 1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def encoded(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(row, key, place on the curve, number of ids, ids as little-endian 32-bit numbers), staged."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for first, data, bounds in blocks(batch.column(2)):
                ids, cuts = encoder.encode(data, bounds)
                n = len(bounds) - 1
                offsets = pa.py_buffer((cuts * 4).astype(np.int32))
                raw = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(ids.astype("<u4"))])
                keys = hilbert_keys(document_points(ids, cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(keys, pa.int64()),
                        pa.array(np.diff(cuts), pa.int64()),
                        raw,
                    ],
                    ["row", "key", "curve", "n_ids", "ids"],
                )

    own = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = own.select("row", "key").schema.add("curve", "long").add("n_ids", "long").add("ids", "binary")
    return stage(own.mapInArrow(encode, schema), "packing-ids")


def along_curve(ids: DataFrame) -> tuple[DataFrame, dict[int, int], int]:
    """(row, range, ids before it in its range) of every document, the ids before each range, and all ids."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = np.cumsum(batch.column(1).to_numpy()) + before
            starts = ends - batch.column(1).to_numpy()
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ends), part), pa.int32()), pa.array(starts), pa.array(ends)],
                ["row", "part", "before", "until"],
            )

    ranges = ids.select("row", "curve", "n_ids").repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    placed = ranges.select("row", "n_ids").mapInArrow(running, "row bigint, part int, before bigint, until bigint")
    placed = stage(placed, "packing-places")
    totals = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.max("until").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part] = total
        total += totals[part]
    return placed.drop("until"), starts, total


def tail_cuts(total: int, length: int = LENGTH) -> list[int]:
    """Starts of the sequences after the last full one: what is left falls into powers of two, largest first."""
    at, cuts = total // length * length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total - at) >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    return cuts


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    length: int = LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it starts, how long it is, and its place in a sequence. ``with_ids``
    adds the ids themselves."""
    ids = encoded(df, key, text, path or public_tokenizers.path(TOKENIZER))
    placed, starts, total = along_curve(ids)
    tail = tail_cuts(total, length)
    full = total // length

    def sequence_at(at: int) -> tuple[int, int, int]:
        """Number, start and end of the sequence that holds the id at ``at``."""
        if at < full * length:
            return at // length, at // length * length, at // length * length + length
        k = max(i for i, cut in enumerate(tail) if cut <= at)
        return full + k, tail[k], tail[k + 1] if k + 1 < len(tail) else total

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (raw, part, before) in enumerate(
                zip(batch.column("ids"), batch.column("part").to_pylist(), batch.column("before").to_pylist(), strict=True)
            ):
                raw, at = memoryview(raw.as_buffer()), starts[part] + before
                n, done = len(raw) // 4, 0
                while done < n:
                    number, begin, end = sequence_at(at + done)
                    size = min(n - done, end - at - done)
                    piece = raw[4 * done : 4 * (done + size)]
                    row = (k, done, size, zlib.crc32(piece), n, number, at + done - begin)
                    rows.append((*row, np.frombuffer(piece, "<u4")) if with_ids else row)
                    done += size
            columns = list(zip(*rows, strict=True)) if rows else [()] * (7 + with_ids)
            arrays = [batch.column("key").take(pa.array(columns[0], pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[1:7]]
            arrays += [pa.array(c, pa.list_(pa.int32())) for c in columns[7:]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ids.select("key").schema
    for name in names[1:7]:
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    joined = ids.select("row", "key", "ids").join(placed, "row")
    return joined.mapInArrow(cut, schema).withColumnRenamed("key", key)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids) from pieces with ids. A sequence has at most ``length`` ids; one whose number of ids
    is no power of two is padded to ``length``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    whole = pieces.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))
    n = F.size("ids")
    padding = F.when(F.bit_count(n) == 1, 0).otherwise(F.lit(length) - n)
    return whole.select(
        "sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), padding)).alias("ids"), n.alias("n_ids")
    )
