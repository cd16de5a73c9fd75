"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the words of the benchmark are counted over all documents.
2. Items of more than PIECE words are cut into equal pieces of up to PIECE words. The TF-IDF matrix of the pieces gets
   a randomised SVD: Spark adds up A'(A X) over the pieces, each scaled to length one, for a random X and again for its
   orthonormal basis. It has as many directions as the block has distinct pieces, so it spans them all: a piece has
   its whole length in the latent space.
3. Every text is read in passages of 2 * STRIDE words, one every STRIDE words. Passages whose cosine with a piece in
   the latent space is at least LEAST_COSINE are candidates for its item. A passage counts as at most SHORT times as
   long as the piece, so that a short item is not lost among the other words of the passage.
4. A candidate is a leak when the longest common subsequence of words of the item and the text around the passage
   covers SURE of the item, or COVERED of it and ANSWER_COVERED of its answer, the last sentence.

Items are handled in blocks of about BLOCK_PIECES pieces (an item is never divided between blocks), each with its own index
and its own pass over all documents, so that what is broadcast is bounded; a filter takes GROUP blocks in one pass.
Every item and every passage takes part.

Words are runs of letters, digits and non-ASCII bytes, lower-cased. Null and empty texts have no passages, and items
without words match nothing; a text shorter than a passage is one passage. Repeated rows are reported row by row; of
repeated item ids, each text is an item of its own. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import where_arrow
from pairloom.llm.words import LOWER_CODES, blocks, span_hashes, word_spans

STRIDE = 16
LEAST_COSINE = 0.3
SURE = 0.8
COVERED = 0.6
ANSWER_COVERED = 0.5
PIECE = 4 * STRIDE
SHORT = 2.0
BLOCK_PIECES = 256  # also the directions of a block's basis, so memory grows with its square
GROUP = 8  # blocks of one filter pass

OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[65:91] = OUTSIDE[97:123] = OUTSIDE[128:] = False
WORD_CODES = np.where(OUTSIDE, np.uint64(0), LOWER_CODES)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block and the bounds of its texts in words. A to Z and U+00C0 to U+00DE are folded."""
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    if len(capital):
        data = data.copy()
        data[capital] += 0x20
    starts, ends, cuts = word_spans(data, bounds, OUTSIDE)
    return span_hashes(data, starts, ends, WORD_CODES), cuts


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


@dataclass
class Index:
    """A block of items: ids, words, answers; their pieces and the item of each; the vocabulary (ascending hashes) with
    weights; the latent basis (words, rank) and the pieces in it, scaled by the length they have in full space."""

    ids: list[int | None]
    items: list[np.ndarray]
    answers: list[np.ndarray]
    pieces: list[np.ndarray]
    item_of: np.ndarray
    vocabulary: np.ndarray
    weights: np.ndarray | None = None
    other: float = 0.0  # weight of a word outside the vocabulary
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    lengths: np.ndarray | None = None  # of the pieces in full space
    most: np.ndarray | None = None  # most that one occurrence of a word adds to the product with any piece
    cells: np.ndarray = field(init=False)

    def __post_init__(self):
        self.cells = np.zeros(1 << 16, bool)
        self.cells[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, words: np.ndarray) -> np.ndarray:
        """Index of every word in the vocabulary, -1 outside."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.cells[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
        found = self.vocabulary[at] == words[maybe]
        out[maybe[found]] = at[found]
        return out


def pieces_of(words: np.ndarray) -> list[np.ndarray]:
    return np.array_split(words, max(1, -(-len(words) // PIECE)))


def new_index(rows: list[tuple[int | None, str | None]]) -> Index:
    rows = [(i, text or "") for i, text in rows]
    items = [words_of(text) for _, text in rows]
    answers = []
    for (_, text), words in zip(rows, items, strict=True):
        last = words_of([s for s in SENTENCE.split(text) if s.strip()][-1]) if text.strip() else words
        answers.append(last if len(last) >= 3 else words[-5:])
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))
    pieces = [pieces_of(words) for words in items]
    item_of = np.repeat(np.arange(len(items)), [len(p) for p in pieces])
    return Index([i for i, _ in rows], items, answers, [p for own in pieces for p in own], item_of, vocabulary)


def weigh(index: Index, df: DataFrame, text: str) -> None:
    """Inverse document frequencies of the vocabulary over all documents. A word outside it weighs as one inside does
    on average."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            texts += len(batch)
            for _, data, bounds in blocks(batch.column(0)):
                words, cuts = word_hashes(data, bounds)
                places = index.places(words)
                text_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                seen = np.unique((text_of * len(total) + places)[places >= 0])
                total += np.bincount(seen % len(total), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))], ["word", "n"]
        )

    rows = df.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {row["word"]: row["n"] for row in rows.collect()}  # a row per word of the block's items at most
    texts = counts.pop(-1, 0)
    found = np.zeros(len(index.vocabulary))
    found[list(counts)] = list(counts.values())
    index.weights = np.log((texts + 1) / (found + 1)) + 0.05
    index.other = float(index.weights.mean())


def latent_basis(index: Index, benchmark: DataFrame) -> None:
    """Randomised SVD of the TF-IDF pieces in ``benchmark`` (one column of text), of full rank: the basis spans every
    distinct piece of the block."""
    n = len(index.vocabulary)
    rank = min(len({np.sort(words).tobytes() for words in index.pieces}), n)

    def product(x: np.ndarray) -> np.ndarray:
        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(x.shape)
            for batch in batches:
                for words in (p for text in batch.column(0).to_pylist() for p in pieces_of(words_of(text or ""))):
                    at, times = np.unique(index.places(words), return_counts=True)
                    at, times = at[at >= 0], times[at >= 0]
                    row = times * index.weights[at]
                    row /= max(np.linalg.norm(row), 1e-9)
                    total[at] += np.outer(row, row @ x[at])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        total = np.zeros(x.shape)
        for row in benchmark.mapInArrow(multiply, "total binary").toLocalIterator():
            total += np.frombuffer(row["total"]).reshape(x.shape)
        return total

    x = np.random.default_rng(3).standard_normal((n, rank))
    for _ in range(2):
        x = np.linalg.qr(product(x))[0]
    index.basis = (x * index.weights[:, None]).astype(np.float32)
    latent, lengths = [], []
    for words in index.pieces:
        at, times = np.unique(index.places(words), return_counts=True)
        length = np.linalg.norm(times * index.weights[at])
        lengths.append(length)
        latent.append((times @ index.basis[at]) / max(length, 1e-9))
    index.latent = np.array(latent, np.float32).reshape(len(latent), rank)
    index.lengths = np.array(lengths)
    index.most = np.concatenate([(index.basis[a : a + 4096] @ index.latent.T).max(axis=1) for a in range(0, n, 4096)])


def candidates(index: Index, words: np.ndarray, cuts: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
    """(text, first word within the text, item, cosine) of the passages of a block."""
    texts = np.flatnonzero(np.diff(cuts) > 0)
    if not len(texts) or not len(index.vocabulary):
        return []
    n_steps = -(-np.diff(cuts)[texts] // STRIDE)
    text_of = np.repeat(texts, n_steps)
    within = np.arange(len(text_of)) - np.repeat(np.cumsum(n_steps) - n_steps, n_steps)
    starts = cuts[text_of] + within * STRIDE
    places = index.places(words)
    known = places >= 0
    weight = np.where(known, index.weights[places], index.other)
    squares = np.add.reduceat(weight * weight, starts)
    bound = np.add.reduceat(np.where(known, index.most[places], 0), starts)
    follows = np.zeros(len(starts), bool)  # the next step is of the same text
    follows[:-1] = text_of[1:] == text_of[:-1]
    both = lambda v: v + np.where(follows, np.append(v[1:], 0), 0)
    length = np.sqrt(both(squares))
    limits = np.where(index.lengths > 0, SHORT * index.lengths, np.inf)
    open_at = np.flatnonzero(both(bound) >= (least - 1e-4) * np.minimum(length, limits.min()))  # products are at most it
    if not len(open_at):
        return []
    used = np.zeros(len(starts), bool)
    used[open_at] = True
    used[1:] |= used[:-1] & follows[:-1]
    step_of = np.searchsorted(starts, np.arange(len(words)), "right") - 1
    take = np.flatnonzero(known & used[step_of])
    sums = np.zeros((len(starts), index.basis.shape[1]), np.float32)
    step = step_of[take]
    first = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
    sums[step[first]] = np.add.reduceat(index.basis[places[take]], first, axis=0)
    passages = sums[open_at]
    pair = follows[open_at]
    passages[pair] += sums[open_at[pair] + 1]
    products = passages @ index.latent.T
    at, piece = np.nonzero(products >= least * np.minimum(length[open_at, None], limits))
    found: dict[tuple[int, int], float] = {}
    for s, i, c in zip(open_at[at], index.item_of[piece], products[at, piece] / length[open_at[at]], strict=True):
        found[s, i] = max(found.get((s, i), 0.0), float(c))
    return [(int(text_of[s]), int(starts[s] - cuts[text_of[s]]), int(i), c) for (s, i), c in found.items()]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    masks: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        if mask := masks.get(word):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def leaks_of_text(index: Index, words: np.ndarray, found: list[tuple[int, int, float]]) -> list[tuple]:
    """(item, cosine, coverage, answer coverage, first, last word of the text around) of the items that leak."""
    best: dict[int, tuple] = {}
    for start, i, cosine in found:
        item = index.items[i]
        if i in best and best[i][2] == 1:
            continue
        first, last = max(0, start - len(item)), min(len(words), start + 2 * STRIDE + len(item))
        around = words[first:last]
        coverage = common_subsequence(item, around) / len(item)
        if coverage < COVERED or (i in best and best[i][2] >= coverage):
            continue
        answer = common_subsequence(index.answers[i], around) / len(index.answers[i])
        if coverage >= SURE or answer >= ANSWER_COVERED:
            best[i] = (i, cosine, coverage, answer, first, last)
    return [best[i] for i in sorted(best)]


def leaks_of_batch(index: Index, column: pa.Array) -> Iterator[tuple[int, tuple]]:
    """(row of the batch, leak) of every leak."""
    for first, data, bounds in blocks(column):
        words, cuts = word_hashes(data, bounds)
        by_text: dict[int, list] = {}
        for text, *rest in candidates(index, words, cuts, LEAST_COSINE):
            by_text.setdefault(text, []).append(rest)
        for text, found in by_text.items():
            for leak in leaks_of_text(index, words[cuts[text] : cuts[text + 1]], found):
                yield first + text, leak


def indexes(
    docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, size: int = BLOCK_PIECES
) -> Iterator[Index]:
    """An index per block of items. Items are dealt to blocks by number; a block is what one pass broadcasts."""
    own = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(pieces_of(words_of(text))) for batch in batches for text in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    total = own.select("text").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // size)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    for b in range(n_blocks):
        rows = own if n_blocks == 1 else own.where(block == b)
        index = new_index(sorted((row["item"] if row["item"] is not None else -1, row["text"]) for row in rows.collect()))
        if len(index.vocabulary):
            weigh(index, docs, text)
            latent_basis(index, rows.select("text"))
            yield index


RESULT = "item_id bigint, cosine double, coverage double, answer_coverage double, first_word bigint, last_word bigint"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` and item that it leaks: cosine of the passage, shares of the item and of its answer
    that the text around it has in order, and where that text is, in words. A null item id comes as -1."""
    own = docs.select(F.col(key).alias(key), F.col(text).alias("text_"))
    schema = own.select(key).schema
    for name, kind in (field.split() for field in RESULT.split(", ")):
        schema = schema.add(name, kind.replace("bigint", "long"))
    result = None
    for index in indexes(docs, benchmark, text, item, item_text):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, leaks = [], []
                for row, leak in leaks_of_batch(index, batch.column(1)):
                    rows.append(row)
                    leaks.append((index.ids[leak[0]], *leak[1:]))
                columns = list(zip(*leaks, strict=True)) or [()] * 6
                kinds = [pa.int64(), *[pa.float64()] * 3, *[pa.int64()] * 2]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], schema.names)

        part = own.mapInArrow(search, schema)
        result = part if result is None else result.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows, with all their columns, that leak no item."""
    at = docs.columns.index(text)
    kept, every = docs, indexes(docs, benchmark, text, item, item_text)
    while group := list(islice(every, GROUP)):

        def keep(batches: Iterator[pa.RecordBatch], group: list[Index] = group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for index in group:
                    clean[[row for row, _ in leaks_of_batch(index, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        kept = where_arrow(kept, keep)
    return kept
