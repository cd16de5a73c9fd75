r"""Byte-level BPE: texts to token ids by ranked merges, and ids back to bytes, in Arrow functions of whole batches.

A text is cut into pieces by the vocabulary's pattern, in Spark. A piece whose bytes are a token is that token. Of any
other piece the bytes are folded: in each step the adjacent pair whose joined bytes have the lowest rank is joined wherever
it stands, until no pair has a rank. All distinct pieces of a thousand rows take their steps together, as one numpy
array of parts, at most WORDS pieces at a time. Texts are never shuffled, and no table of words is kept.

Decoding gathers each id's bytes from one array of all tokens.

A null or empty text has no ids. Null ids in a list are left out, and ids outside the vocabulary decode to nothing.
Texts and single pieces may be of any length; a long piece costs as many passes over it as it has kinds of merges.
Repeated rows are encoded alike, and there are no ties. An empty table gives an empty table. Other columns stay as
they are; an output name that is taken is replaced, as ``withColumn`` does.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
WORDS = 1 << 15  # pieces that are folded together
ROWS = 1 << 10  # whose pieces are handled together
SHORT = 48  # parts; shorter pieces join one pair in a step
ID_BITS = 20  # ids are below 2 ** 20
NO_RANK = 1 << ID_BITS
NAMES = ["n_tokens", "ids_sha256", "decoded_sha256"]
NONE = -1

# --- fixed values -----------------------------------------------------------------------------
# White space, and the letters and numbers that Unicode 16 has beyond the oldest supported Java.
SPACE = r"\t-\r \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NEW_LETTERS = """870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD
A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9
105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072
11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02
11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3
1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED
1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"""
NEW_NUMBERS = """10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9
1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"""
FIRST_NEW = "870"
# ----------------------------------------------------------------------------------------------


def _ranges(text: str) -> str:
    return "".join("-".join(rf"\x{{{end}}}" for end in part.split("-")) for part in text.split())


def _pattern(letters: str = r"\p{L}", numbers: str = r"\p{N}") -> str:
    """The vocabulary's pattern with its classes spelled out, as Java's own white space is ASCII."""
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{letters}{numbers}]")
    pattern = pattern.replace(r"\p{L}+", f"[{letters}]+", 1).replace(r" ?\p{N}+", f" ?[{numbers}]+", 1)
    return pattern.replace(r"\s", f"[{SPACE}]").replace(r"(?!\S)", f"(?![^{SPACE}])")


PLAIN = _pattern()
FULL = _pattern(r"\p{L}" + _ranges(NEW_LETTERS), r"\p{N}" + _ranges(NEW_NUMBERS))


def pieces(text: Column) -> Column:
    """The pieces of a text. Only texts with a late character pay for the classes with all new ranges."""
    late = text.rlike(rf"[\x{{{FIRST_NEW}}}-\x{{10FFFF}}]")
    found = F.when(late, F.regexp_extract_all(text, F.lit(FULL), F.lit(0)))
    return found.otherwise(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)))


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all items of slices, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of a column of lists, and the n + 1 bounds of the lists in them. A null is an empty list."""
    return column.flatten(), _bounds(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))


def _by_slices(use: Callable[[pa.Array], pa.Array], column: pa.Array, rows: int) -> pa.Array:
    """``use`` of the column, of few rows at a time: what it needs beside the result is bounded by them."""
    return pa.concat_arrays([use(column.slice(i, rows)) for i in range(0, max(1, len(column)), rows)])


def _binaries(column: pa.Array, bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """Slices of bytes as a column, null where ``column`` is."""
    buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    values = pa.Array.from_buffers(pa.binary(), len(column), buffers)
    return pc.if_else(column.is_valid(), values, pa.scalar(None, pa.binary()))


class PairRanks:
    """The rank map: which token two adjacent tokens make, whose id is its rank. A sparse matrix with a row for each
    left token, laid out as one array: each row is shifted at random until its entries meet no other."""

    def __init__(self, ranks: dict[bytes, int], size: int):
        rows: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    rows.setdefault(left, {})[right] = rank
        width = 4 * sum(map(len, rows.values())) + 1
        table = np.full(width + size, NONE, np.int64)
        free, shift, rng = np.ones(len(table), bool), np.zeros(size, np.int64), np.random.default_rng(1)
        for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
            right = np.fromiter(rows[left], np.int64)
            fits = ()
            while not len(fits):
                shifts = rng.integers(0, width, max(1, min(64, 4096 // len(right))))
                fits = shifts[free[shifts[:, None] + right].all(axis=1)]
            shift[left] = fits[0]
            free[fits[0] + right] = False
            table[fits[0] + right] = (left << ID_BITS) + np.fromiter(rows[left].values(), np.int64)
        self.shift, self.table = shift, table

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of pairs of ids; NO_RANK where they make no token."""
        entry = self.table[self.shift[left] + right]
        return np.where((entry >> ID_BITS == left) & (left >= 0) & (right >= 0), entry & (NO_RANK - 1), NO_RANK)


def _apart(places: np.ndarray) -> np.ndarray:
    """Of ascending places, those that stay when each one, from the left, takes the next place away."""
    i = np.arange(len(places))
    begun = np.maximum.accumulate(np.where(np.diff(places, prepend=-2) > 1, i, 0))
    return places[(i - begun) % 2 == 0]


class Vocabulary:
    """One rank file."""

    def __init__(self, path: str | None = None):
        self.ranks = read_ranks(path or public_tokenizers.path(RANKS))
        self.size = max(self.ranks.values()) + 1


class Folding:
    """The ids of pieces by a vocabulary's ranks."""

    def __init__(self, vocabulary: Vocabulary):
        ranks = vocabulary.ranks
        self.pairs = PairRanks(ranks, vocabulary.size)
        self.single = np.array([ranks.get(bytes([b]), NONE) for b in range(256)], np.int64)
        self.tokens, self.ids = list(ranks), np.fromiter(ranks.values(), np.int64)

    def folded(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of bytes by ranked merges, end to end, and how many each piece has."""
        parts, owner = self.single[data], np.repeat(np.arange(len(lengths)), lengths)
        done = [(parts[:0], owner[:0])]
        while len(parts):
            inside = np.append(owner[1:] == owner[:-1], False)  # not the last part of its piece
            left = np.flatnonzero(inside)
            rank = np.full(len(parts), NO_RANK, np.int64)
            rank[left] = self.pairs.rank(parts[left], parts[left + 1])
            starts = np.concatenate([[0], np.flatnonzero(~inside)[:-1] + 1])
            sizes = np.diff(np.append(starts, len(parts)))
            # of the lowest rank in each piece the leftmost place
            best = np.minimum.reduceat((rank << 32) + np.arange(len(parts)), starts)
            at, ended = best & ((1 << 32) - 1), best >> 32 == NO_RANK
            joined = np.zeros(len(parts), bool)
            joined[at[~ended]] = True
            for i in np.flatnonzero(~ended & (sizes > SHORT)):  # in a long piece wherever the pair stands
                own = parts[starts[i] : starts[i] + sizes[i]]
                a, b = parts[at[i]], parts[at[i] + 1]
                places = np.flatnonzero((own[:-1] == a) & (own[1:] == b))
                joined[starts[i] + (_apart(places) if a == b else places)] = True
            parts[joined] = rank[joined]
            ended = np.repeat(ended, sizes)
            done.append((parts[ended], owner[ended]))
            stay = ~ended
            stay[1:] &= ~joined[:-1]
            parts, owner = parts[stay], owner[stay]
        parts, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        return parts[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, end to end, and how many each has."""
        whole = pc.index_in(words, pa.array(self.tokens, pa.binary())).fill_null(NONE).to_numpy()
        bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        other = whole == NONE
        sizes = np.diff(bounds)[other]
        ids, counts = self.folded(data[_ragged(bounds[:-1][other], sizes)], sizes)
        lengths = np.ones(len(words), np.int64)
        lengths[other] = counts
        out = np.empty(lengths.sum(), np.int64)
        single = np.repeat(~other, lengths)
        out[single], out[~single] = self.ids[whole[~other]], ids
        return out, lengths

    def batch(self, column: pa.Array, words: int) -> pa.Array:
        """Ids of texts that are lists of pieces."""
        pieces, bounds = _lists(column)
        coded = pieces.dictionary_encode()
        distinct, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
        found = [self.ids_of(distinct.slice(i, words)) for i in range(0, len(distinct), words)]
        ids = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
        lengths = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
        values = ids[_ragged((np.cumsum(lengths) - lengths)[codes], lengths[codes])]
        ends = _bounds(lengths[codes])[bounds]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


class Decoding:
    """The bytes of ids of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = {rank: token for token, rank in vocabulary.ranks.items()}
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(vocabulary.size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def batch(self, column: pa.Array) -> pa.Array:
        """The bytes of lists of ids."""
        return _by_slices(self._gathered, column, ROWS // 4)

    def _gathered(self, column: pa.Array) -> pa.Array:
        items, bounds = _lists(column)
        items = items.fill_null(NONE).to_numpy(zero_copy_only=False)
        known = (items >= 0) & (items < len(self.lengths))
        items = np.where(known, items, 0)
        sizes = np.where(known, self.lengths[items], 0)
        return _binaries(column, _bounds(sizes)[bounds], self.bytes[_ragged(self.starts[items], sizes)])


def little_endian(column: pa.Array) -> list[bytes]:
    """Lists of ids as little-endian unsigned 32-bit numbers, end to end."""
    items, bounds = _lists(column)
    packed = items.to_numpy(zero_copy_only=False).astype("<u4")
    return [packed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encode(
    df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, words: int = WORDS
) -> DataFrame:
    """``df`` with the token ids of ``text`` as an array of integers."""
    folding, at_once = Folding(Vocabulary(path)), max(1, words)

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        return _by_slices(lambda part: folding.batch(part, at_once), column, ROWS)

    return df.withColumn(out, encoded(pieces(F.coalesce(F.col(f"`{text}`"), F.lit("")))))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the bytes of the token ids in ``ids``."""
    decoding = Decoding(Vocabulary(path))

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        return decoding.batch(column)

    return df.withColumn(out, decoded(F.col(f"`{ids}`")))


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row."""
    vocabulary = Vocabulary(path)
    folding, decoding = Folding(vocabulary), Decoding(vocabulary)

    def of(column: pa.Array) -> pa.Array:
        ids = folding.batch(column, WORDS)
        both = little_endian(ids), decoding.batch(ids).to_pylist()
        hashes = [pa.array([hashlib.sha256(raw).hexdigest() for raw in column], pa.string()) for column in both]
        return pa.StructArray.from_arrays([pc.list_value_length(ids).cast(pa.int64()), *hashes], NAMES)

    # one function, as a plan of several would encode once for each; it does what encode and decode do
    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(column: pa.Array) -> pa.Array:
        return _by_slices(of, column, ROWS)

    found = digested(pieces(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = df.select(F.col(f"`{key}`").alias(key), found.alias("found"))
    return rows.select(F.col(f"`{key}`"), *[F.col(f"found.{c}") for c in NAMES])
