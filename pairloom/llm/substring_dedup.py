"""Removal of passages that repeat anywhere, by recompression.

A window is ``size`` consecutive words of one text. Every word is removed that is covered by a window whose words
also start at another place of any text, the same text included.

The words of a text are compressed in rounds: first runs of one symbol get a name, then neighbours of which the left
is of the round's left half and the right of its right half. A name is a fingerprint of what it stands for, so equal
runs and pairs have equal names everywhere. What became of a symbol depends on few words around it; these are kept
as its context, and a window that holds the context of a symbol holds that symbol wherever it occurs. Of the symbol
pairs that a window so holds, the first with the smallest name gives the window its name (a window that holds none is
named by its own words). Equal windows therefore have equal names, and stretches of windows get theirs from one place:

1. All texts give (name, stretch of windows). A name that only one place gives rules out its windows.
2. The windows left are counted by a 96-bit fingerprint of their words. Nearly all of them repeat, so it is the few that
   occur once whose places come back, straight from the counting.
3. The texts lose the words that the other windows cover.

A null text has no words. Texts with fewer than ``size`` words lose nothing. Repeated rows repeat each other: all
their windows occur twice. An empty table gives an empty result. Other columns are not read. Rows are told apart by
key and a 64-bit fingerprint of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import stage
from pairloom.llm.words import BLOCK_BYTES, blocks, chained, hashed_words, mix, word_spans

WINDOW = 35
ROUNDS = 4
PRIME = np.uint64(0xD1B54A32D192ED03)


class Parsed:
    """Symbols of several texts: names, the text of each, and the first and last word that its forming depends on.
    The word before a text and the word after it count as parts of the context of its first and last symbol."""

    def __init__(self, names: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.names, self.text, self.low, self.high = names, text, low, high

    def merged(self, first: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> Parsed:
        starts = np.flatnonzero(first)
        return Parsed(names, self.text[starts], low, high)

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Low of the symbol before and high of the symbol after, or one word beyond the text."""
        before, after = self.low - 1, self.high + 1
        inner = self.text[1:] == self.text[:-1]
        before[1:] = np.where(inner, self.low[:-1], before[1:])
        after[:-1] = np.where(inner, self.high[1:], after[:-1])
        return before, after

    def runs_named(self) -> Parsed:
        first = np.ones(len(self.names), bool)
        first[1:] = (self.names[1:] != self.names[:-1]) | (self.text[1:] != self.text[:-1])
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(self.names))
        before, after = self._neighbours()
        length = (ends - starts).astype(np.uint64)
        names = self.names[starts]
        names = np.where(length > 1, mix(names * PRIME + length), names)
        return self.merged(first, names, before[starts], after[ends - 1])

    def pairs_named(self, salt: int) -> Parsed:
        right = (mix(self.names + np.uint64(salt)) & np.uint64(1)).astype(bool)
        joined = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])  # with the next
        first = np.ones(len(self.names), bool)
        first[1:] = ~joined
        starts = np.flatnonzero(first)
        before, after = self._neighbours()
        # a right symbol depends on the one before, a left one on the one after, a pair on itself
        low, high = np.where(right, before, self.low), np.where(right, self.high, after)
        names = self.names.copy()
        at = np.flatnonzero(joined)
        names[at] = mix(self.names[at] * PRIME + mix(self.names[at + 1]))
        low[at], high[at] = self.low[at], self.high[at + 1]
        return self.merged(first, names[starts], low[starts], high[starts])


def parse(words: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> Parsed:
    at = np.arange(len(words))
    parsed = Parsed(words, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), at, at)
    for r in range(rounds):
        parsed = parsed.runs_named().pairs_named(r + 1)
    return parsed


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the first smallest of values[low:high] for every range; -1 where a range has nothing."""
    out = np.full(len(low), -1, np.int64)
    length = high - low
    table, width = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    while width <= int(length.max(initial=0)):
        fits = (length >= width) & (length < 2 * width)
        out[fits] = better(table[low[fits]], table[high[fits] - width])
        table = better(table[:-width], table[width:])
        width *= 2
    return out


def window_names(
    words: np.ndarray, bounds: np.ndarray, size: int, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and name of every window of a block, starts as words of the block, and which symbol pair gave the name
    (a number of its own for a window without)."""
    n = np.diff(bounds)
    whole = chained(words, size)
    inside = np.zeros(len(words) + 1, np.int64)
    some = n >= size
    np.add.at(inside, bounds[:-1][some], 1)
    np.add.at(inside, bounds[1:][some] - size + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    if not len(starts):
        return starts, whole[:0], starts
    p = parse(words, bounds, rounds)
    own = mix(whole[starts] ^ np.uint64(0x5851F42D4C957F2D))
    together = p.text[1:] == p.text[:-1]
    names = mix(p.names[:-1] * PRIME + mix(p.names[1:] + PRIME))[together]
    low, high = p.low[:-1][together], p.high[1:][together]
    alone = -1 - np.arange(len(starts))
    if not len(names):
        return starts, own, alone
    first = np.searchsorted(low, starts, "left")
    last = np.searchsorted(high, starts + size - 1, "right")
    given = range_minima(names, first, np.maximum(last, first))
    return starts, np.where(given >= 0, names[given], own), np.where(given >= 0, given, alone)


def row_prints(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint of the words of every text."""
    with np.errstate(over="ignore"):
        within = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
        placed = mix(words + within.astype(np.uint64) * PRIME)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)])
        return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def stretches(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(name, key, print, first, last): stretches of windows named by one place, by word of their text."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in blocks(batch.column(1)):
                words, cuts = hashed_words(data, bounds)
                starts, names, given = window_names(words, cuts, size)
                if not len(starts):
                    continue
                text_of = np.searchsorted(cuts, starts, "right") - 1
                new = np.ones(len(starts), bool)
                new[1:] = (given[1:] != given[:-1]) | (starts[1:] != starts[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(starts)) - 1
                text_of = text_of[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[first].view(np.int64)),
                        batch.column(0).take(pa.array(at + text_of)),
                        pa.array(row_prints(words, cuts)[text_of]),
                        pa.array((starts[first] - cuts[text_of]).astype(np.int32)),
                        pa.array((starts[last] - cuts[text_of]).astype(np.int32)),
                    ],
                    ["name", "key", "print", "first", "last"],
                )

    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(name, _schema(own, "name long", "key", "print long", "first integer", "last integer"))


def _schema(df: DataFrame, *fields: str):
    """A schema of the fields, each a name with a type, or a column of ``df``."""
    schema = df.select().schema
    for field in fields:
        name, _, kind = field.partition(" ")
        schema = schema.add(name, kind) if kind else schema.add(df.schema[name])
    return schema


def packed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, packed): every text as a compressed column, for the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at, data, bounds in blocks(batch.column(1)):
                words, cuts = hashed_words(data, bounds)
                raw = data.tobytes()
                packed = [press.compress(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(packed)),
                        pa.array(row_prints(words, cuts)),
                        pa.array(packed, pa.binary()),
                    ],
                    ["key", "print", "packed"],
                )

    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(pack, _schema(own, "key", "print long", "packed binary"))


def _with(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Rows with what ``places`` has for them; keys may be null."""
    places = places.withColumnsRenamed({"key": "place_key", "print": "place_print"})
    # null-safe on both sides, so that no join filters its texts and both read the one shuffle of them
    same = texts["key"].eqNullSafe(places["place_key"]) & texts["print"].eqNullSafe(places["place_print"])
    return texts.join(places, same, how).drop("place_key", "place_print")


def open_windows(texts: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(one, two, key, print, start) of the windows in the stretches of every row."""

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in unpacked(batch.column(2)):
                words, cuts = hashed_words(data, bounds)
                starts, row = starts_in(batch.column(3).slice(at, len(bounds) - 1), cuts)
                one = chained(words, size)[starts]
                two = chained(mix(words + PRIME), size)[starts]
                own = pa.array(at + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)),
                        pa.array((two >> np.uint64(33)).astype(np.int32)),
                        batch.column(0).take(own),
                        batch.column(1).take(own),
                        pa.array((starts - cuts[row]).astype(np.int32)),
                    ],
                    ["one", "two", "key", "print", "start"],
                )

    rows = _with(texts, places, "inner")
    return rows.mapInArrow(window, _schema(rows, "one long", "two integer", "key", "print long", "start integer"))


def unpacked(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, bounds) of blocks of compressed texts, as ``blocks`` gives them."""
    unpack = zstandard.ZstdDecompressor()
    first, raws, length = 0, [], 0
    for i, packed in enumerate(column, 1):
        raws.append(unpack.decompress(packed.as_buffer()))
        length += len(raws[-1])
        if length >= BLOCK_BYTES or i == len(column):
            bounds = np.cumsum([0, *map(len, raws)])
            yield first, np.frombuffer(b"".join(raws), np.uint8), bounds
            first, raws, length = i, [], 0


def starts_in(places: pa.ListArray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window starts, as words of a block, in the places of its texts, and their texts."""
    places = places.fill_null([]) if places.null_count else places
    first, last = (places.flatten().field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
    row = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
    times = last - first + 1
    before = np.cumsum(times) - times
    starts = np.arange(times.sum()) + np.repeat(first + cuts[row] - before, times)
    return starts, np.repeat(row, times)


def repeats(df: DataFrame, texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, print, places, singles) of every row with repeated windows: stretches of window starts, and the starts in
    these that do not repeat."""
    rows = stretches(df, key, text, size)
    often = stage(rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "dedup-names")
    inside = rows.join(often, "name").groupBy("key", "print")
    places = stage(inside.agg(F.collect_set(F.struct("first", "last")).alias("places")), "dedup-places")
    windows = open_windows(texts, places, size).groupBy("one", "two")
    fields = ("key", "print", "start")
    once = windows.agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in fields]).where("n = 1")
    singles = once.groupBy("key", "print").agg(F.collect_list("start").alias("singles"))
    return _with(places, singles, "left")


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words the windows at ``starts`` cover."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def kept_bytes(data: np.ndarray, bounds: np.ndarray, gone: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """The words of every text that are not ``gone``, given the bounds of the texts in words, joined by one space: all
    bytes, their bounds, and how many words each text has and loses."""
    starts, ends, cuts = word_spans(data, bounds)
    out = gone(cuts)
    losses = np.concatenate([[0], np.cumsum(out)])
    stay = np.flatnonzero(~out)
    text = np.searchsorted(cuts, stay, "right") - 1
    later = np.append(False, text[1:] == text[:-1])[: len(stay)]  # after another word that stays: with the byte before it
    low, high = starts[stay] - later, ends[stay]
    steps = np.zeros(len(data) + 1, np.int8)
    np.add.at(steps, low, 1)
    np.add.at(steps, high, -1)
    inside = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    spaced = data.copy()
    spaced[low[later]] = 32
    total = np.concatenate([[0], np.cumsum(inside)])
    return spaced[inside], total[bounds], np.diff(cuts), losses[cuts[1:]] - losses[cuts[:-1]]


def dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, with_text: bool = False
) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row; ``with_text`` adds the kept words joined by spaces."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in unpacked(batch.column(2)):
                rows = len(bounds) - 1

                def gone(cuts: np.ndarray) -> np.ndarray:
                    starts, _ = starts_in(batch.column(3).slice(at, rows), cuts)
                    singles = batch.column(4).slice(at, rows)
                    singles = singles.fill_null([]) if singles.null_count else singles
                    own = np.repeat(cuts[:-1], singles.value_lengths().to_numpy())
                    alone = np.zeros(cuts[-1] + 1, bool)
                    alone[singles.flatten().to_numpy() + own] = True
                    return covered(cuts[-1], starts[~alone[starts]], size)

                whole, ends, words, lost = kept_bytes(data, bounds, gone)
                raw = whole.tobytes()
                texts = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [pa.array(words), pa.array(lost), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                columns += [pa.array([t.decode() for t in texts], pa.string())] * with_text
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), *columns], ["key", *names])

    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    texts = packed_texts(df, key, text)
    rows = _with(texts, repeats(df, texts, key, text, size), "left")
    fields = ["n_words long", "n_removed long", "kept_sha256 string"] + ["kept_text string"] * with_text
    return rows.mapInArrow(keep, _schema(rows, "key", *fields)).withColumnRenamed("key", key)


ORACLE = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM windows WHERE h IN (SELECT h FROM twice)),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT f.doc_id, count(*) AS n, string_agg(f.word, ' ' ORDER BY f.i) AS t FROM flat f
  ANTI JOIN covered c ON f.doc_id = c.doc_id AND f.i = c.i GROUP BY f.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
