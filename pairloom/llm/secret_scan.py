"""Secret scanning by dictionary-primed compression novelty.

Base patterns are found by regular expression. Beyond them, strings before or after a sensitive word are candidates:
each is compressed with zstandard together with the text around it, primed with a dictionary of the identifiers that stand
near sensitive words anywhere in the corpus. What the candidate adds to the compressed size is its novelty. Keys
and passwords add almost a byte per character, identifiers and prose add less, and only the former are reported.
A candidate whose only letters or digits are letters of one case must also be unlike the words of the dictionary: its
letter pairs must take LEAST_SURPRISE bits on average, as a long word that the dictionary lacks is novel, too.

The dictionary counts identifiers over all documents and keeps the most frequent ones up to DICTIONARY_BYTES, without
long ones whose letter pairs are unlike those of the others: these may be secrets.
Offsets are code points, ends are exclusive. Null and empty texts have no spans. Rows are judged one by one, so
repeated rows get equal results, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import free_name

# fixed values: the base patterns, in the order in which kinds are listed
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 and more
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = (
    "password passwd passphrase pwd secret token api_key apikey api-key bearer credential auth private login session "
    "signature cookie access_key access-key client_id connection"
).split()
REACH = 80  # a candidate is less than this far from a sensitive word
AROUND = 256  # characters of text on each side that the candidate is compressed with
LEAST_LENGTH = 12
LEAST_NOVELTY = 0.75  # compressed bytes that the candidate adds, per character
LEAST_SURPRISE = 4.9  # bits per letter pair; 26 letters at random have 4.7 if all are alike
DICTIONARY_BYTES = 64 << 10
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@#$^&*-]{%d,}" % LEAST_LENGTH)
LETTERS = re.compile(r"[a-z]+")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{4,40}(?![A-Za-z0-9_])")  # no digits: keys stay out

FIELDS = pa.struct(
    [
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        ("n_novel", pa.int64()),
    ]
)
FIELDS_DDL = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"

Span = tuple[int, int, int]  # start, index of the kind, end


def base_spans(text: str) -> list[Span]:
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word in SENSITIVE:
        words.add_word(word, word)
    words.make_automaton()
    return words


def _sensitive(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Start and end of every sensitive word, by end."""
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A to Z only
    return [(last + 1 - len(word), last + 1) for last, word in words.iter(folded)]


def _contexts(text: str, words: ahocorasick.Automaton) -> Iterator[tuple[int, int]]:
    """Ranges of the text around sensitive words, merged where they overlap."""
    open_at = until = -1
    for start, end in sorted(_sensitive(text, words)):
        if start - REACH > until:
            if until >= 0:
                yield open_at, until
            open_at = max(0, start - REACH)
        until = max(until, end + REACH)
    if until >= 0:
        yield max(0, open_at), until


def candidates(text: str, words: ahocorasick.Automaton) -> Iterator[tuple[int, int]]:
    """Strings near a sensitive word. Of one that only holds sensitive words itself, the parts between them."""
    places = _sensitive(text, words)
    if not places:
        return
    starts, ends = sorted(a for a, _ in places), [b for _, b in places]
    for m in CANDIDATE.finditer(text):
        first, last = m.span()
        at, after = bisect_right(ends, first), bisect_left(starts, last)
        if (at and first - ends[at - 1] < REACH) or (after < len(starts) and starts[after] - last < REACH):
            yield first, last
            continue
        inside = sorted(p for p in places[at : bisect_right(ends, last)] if p[0] >= first)
        for a, b in [*inside, (last, last)] if inside else []:
            if a - first >= LEAST_LENGTH:
                yield first, a
            first = max(first, b)


class Letters:
    """How unlike a word a string is: bits per letter pair, by the pairs of distinct words."""

    def __init__(self, words: Iterable[str]):
        self.pairs, self.firsts, self.seconds = Counter(), Counter(), Counter()
        self.known = {word.lower() for word in words}
        for word in self.known:
            self._add(word, 1)

    def _add(self, word: str, n: int) -> None:
        for a, b in _letter_pairs(word):
            self.pairs[a, b] += n
            self.firsts[a] += n
            self.seconds[b] += n

    def surprise(self, candidate: str) -> float:
        """Infinite without pairs. A known word does not count for itself."""
        word = candidate.lower()
        pairs = _letter_pairs(word)
        if not pairs:
            return math.inf
        own = word in self.known
        if own:
            self._add(word, -1)
        total = self.firsts.total()
        bits = 0.0
        for a, b in pairs:
            alone = (self.seconds[b] + 1) / (total + 26)
            bits -= math.log2((self.pairs[a, b] + 2 * alone) / (self.firsts[a] + 2))
        if own:
            self._add(word, 1)
        return bits / len(pairs)


def _letter_pairs(word: str) -> list[tuple[str, str]]:
    return [(a, b) for run in LETTERS.findall(word) for a, b in zip(run, run[1:], strict=False)]


def identifier_dictionary(df: DataFrame, text: str = "text", size: int = DICTIONARY_BYTES) -> bytes:
    """Identifiers near sensitive words in any document, the most frequent last, as zstandard wants it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _automaton()
        for batch in batches:
            counts: Counter[str] = Counter()
            for value in batch.column(0):
                body = value.as_py() or ""
                for start, end in _contexts(body, words):
                    counts.update(IDENTIFIER.findall(body, start, end))
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["name", "n"]
            )

    most = (
        df.select(text)
        .mapInArrow(count, "name string, n bigint")
        .groupBy("name")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "name")
        .limit(size // 5)  # an identifier has four characters at least
        .collect()
    )
    letters = Letters([*(row["name"] for row in most), *SENSITIVE])
    kept, left = [], size
    for row in most:
        if len(row["name"]) >= LEAST_LENGTH and letters.surprise(row["name"]) >= LEAST_SURPRISE:
            continue
        left -= len(row["name"]) + 1
        if left < 0:
            break
        kept.append(row["name"])
    return " ".join([*kept[::-1], *SENSITIVE]).encode()


class Novelty:
    """Compressed bytes that a candidate adds to its surroundings."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.letters = Letters(dictionary.decode().split())
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = len(self.compressor.compress((before + after).encode("utf-8", "replace")))
        whole = len(self.compressor.compress((before + candidate + after).encode("utf-8", "replace")))
        return (whole - around) / len(candidate)


def _mixed(candidate: str) -> bool:
    """Two of lower case, upper case inside, digits, and others, as keys and passwords have."""
    kinds = [
        any(c.islower() for c in candidate),
        any(c.isupper() for c in candidate[1:]),
        any(c.isdigit() for c in candidate),
    ]
    return sum(kinds) >= 2


def _least_novelty(candidate: str) -> float:
    """LEAST_NOVELTY for six bits a character, in proportion less where only letters of one case or only digits are."""
    if _mixed(candidate) or not any(map(str.isalnum, candidate)):
        return LEAST_NOVELTY
    return LEAST_NOVELTY * math.log2(26 if any(map(str.isalpha, candidate)) else 10) / 6


def novel_spans(text: str, base: list[Span], novelty: Novelty, words: ahocorasick.Automaton) -> list[Span]:
    """Incompressible strings near sensitive words, clear of the base spans."""
    found = []
    for start, end in candidates(text, words):
        if any(start < b_end and b_start < end for b_start, _, b_end in base):
            continue
        own = text[start:end]
        if not _mixed(own) and novelty.letters.surprise(own) < LEAST_SURPRISE:
            continue
        if novelty(text[max(0, start - AROUND) : start], own, text[end : end + AROUND]) >= _least_novelty(own):
            found.append((start, 3, end))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _all_spans(text: str, novelty: Novelty, words: ahocorasick.Automaton) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, novelty, words))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """For every row: counts per kind, a digest of the base spans, and all spans."""
    dictionary = identifier_dictionary(df, text) if dictionary is None else dictionary

    @F.arrow_udf(FIELDS_DDL)
    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty, words = Novelty(dictionary), _automaton()
        for column in columns:
            rows = []
            for value in column:
                base, spans = _all_spans(value.as_py() or "", novelty, words)
                n = Counter(kind for _, kind, _ in spans)
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((n[0], n[1], n[2], digest, listed(spans), n[3]))
            yield pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], fields=list(FIELDS)
            )

    return df.select(F.col(key).alias("key"), judged(F.col(text)).alias("found")).select(
        F.col("key").alias(key), "found.*"
    )


def redact(
    df: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = None, dictionary: bytes | None = None
) -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; spans that overlap are replaced as one.
    ``length`` names a column with the text's length in code points, which follows the text."""
    dictionary = identifier_dictionary(df, text) if dictionary is None else dictionary

    @F.arrow_udf("string")
    def cleaned(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty, words = Novelty(dictionary), _automaton()
        for column in columns:
            out = []
            for value in column:
                body = value.as_py()
                spans = _all_spans(body or "", novelty, words)[1]
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [body[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, body[at:]]) if spans else body)
            yield pa.array(out, pa.string())

    if length is None:
        return df.withColumn(text, cleaned(F.col(text)))
    clean = free_name(df, "clean_text")
    changed = F.coalesce(F.col(clean) != F.col(text), F.lit(False))
    return (
        df.withColumn(clean, cleaned(F.col(text)))
        .withColumn(length, F.when(changed, F.length(clean).cast("long")).otherwise(F.col(length)))
        .withColumn(text, F.col(clean))
        .drop(clean)
    )
