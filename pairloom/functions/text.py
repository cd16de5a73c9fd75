"""Text expressions. All run JVM-side except Unicode normalisation and character names."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------------------------
# Unicode whitespace as Python's str.strip()/str.split()/\s see it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set, and the Python word class \w, for use inside a Java character class.
WS = r"\p{IsWhite_Space}\x1c\x1d\x1e\x1f"
WORD = r"\p{L}\p{N}_"
# Script classes used by the column guards.
LATIN = "A-Za-z"
ARABIC = r"\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF"
ARABIC_NARROW = r"\u0600-\u06FF\u0750-\u077F"
# ASCII punctuation (Python's string.punctuation), peeled off words by chrF++.
PUNCT = r"\p{Punct}"
# "13a" tokenisation, in order of application. Marks are tested before what stands in front of them, so
# that a scan stops at marks only; a second mark right after one is skipped, as published.
BLEU_LITERALS = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
BLEU_RULES = [
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([\.,])(?<=[^0-9][\.,])([\.,]?)", " $1 $2"),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"(-)(?<=[0-9]-)", " - "),
]
# ----------------------------------------------------------------------------------------------


def strip_text(col: Column) -> Column:
    """Cut Unicode whitespace off both ends."""
    return F.trim(col.cast("string"), F.lit(WHITESPACE))


def drop_whitespace(col: Column) -> Column:
    return F.regexp_replace(col, f"[{WS}]+", "")


def words(col: Column) -> Column:
    """Split on Unicode whitespace; no empty elements."""
    return F.array_remove(F.split(col, f"[{WS}]+"), "")


def tokenize(col: Column) -> Column:
    """Lower-cased runs of word characters, and every other visible character on its own."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"[{WORD}]+|[^{WORD}{WS}]"), F.lit(0))


def chrf_words(col: Column) -> Column:
    """Words with one trailing, else one leading, punctuation mark split off.

    A space is put in at these marks, the leading ones first: such a word does not end in a mark. Marks are tested before
    what stands around them, and letters a-z before the other classes, so that a scan stops at few places.
    """
    mark, visible, no_mark = f"[{PUNCT}]", f"[a-z[^{WS}]]", f"[a-z[^{WS}{PUNCT}]]"
    leading = f"({mark})(?<!{visible}{mark})(?={visible}*{no_mark}(?!{visible}))"
    trailing = f"({mark})(?!{visible})(?<={visible}{mark})"
    return words(F.regexp_replace(F.regexp_replace(col, leading, "$1 "), trailing, " $1"))


def bleu_tokens(col: Column) -> Column:
    """The 13a tokenisation."""
    out = F.rtrim(col, F.lit(WHITESPACE))
    for old, new in BLEU_LITERALS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, replacement in BLEU_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return words(out)


def count_class(col: Column, char_class: str) -> Column:
    """How many characters of ``col`` lie in a regex character class (given without brackets)."""
    return F.length(F.regexp_replace(col, f"[^{char_class}]+", "")).cast("long")


def with_prefix(col: Column, prefix: str | None) -> Column:
    return F.concat(F.lit(prefix), col) if prefix else col


def codepoint_label(col: Column) -> Column:
    """``U+XXXX`` of the first character."""
    digits = F.hex(F.ascii(col))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


@F.arrow_udf(StringType())
def _normalize_nfc(values: pa.Array) -> pa.Array:
    # not pyarrow's utf8_normalize: its NFC leaves text decomposed
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in values.to_pylist()], pa.string())


def _classes(codes: list[int], gap: int) -> str:
    """A character class of ranges that covers ``codes``; ranges up to ``gap`` apart become one."""
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in ranges)


@cache
def not_surely_nfc() -> str:
    """Pattern of texts that may not be NFC: a character whose NFC quick check is not yes, or two marks in a row, whose
    order may be wrong. Marks are looked up in the engine's tables first, and what those do not know counts as one; other
    characters are covered by a few wide ranges."""
    joins = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # Hangul vowels and finals
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if parts and not parts[0].startswith("<"):
            if unicodedata.normalize("NFC", chr(code)) != chr(code):
                joins.add(code)
            elif len(parts) == 2:
                joins.add(int(parts[1], 16))  # composes with a character before it
    marks = [c for c in joins if unicodedata.category(chr(c))[0] == "M"]
    others = [c for c in joins if unicodedata.category(chr(c))[0] != "M"]
    mark = r"\p{M}\p{Cn}"
    return f"[{mark}&&[{_classes(marks, 1)}]]|[{_classes(others, 64)}]|[{mark}][{mark}]"


def needs_nfc(col: Column) -> Column:
    """The texts that may have to be normalised; null for all others. Two tests, the cheap one first."""
    return F.when(col.rlike(r"[^\x{0}-\x{2FF}]"), F.when(col.rlike(not_surely_nfc()), col))


def nfc(col: Column) -> Column:
    """Unicode NFC. Only text that fails the quick check reaches Python: text of characters below U+0300 does not, nor
    does, for one, Arabic text without hamza or madda marks and without two marks in a row."""
    return F.coalesce(_normalize_nfc(needs_nfc(col)), col)


@F.arrow_udf(StringType())
def _unicode_name(values: pa.Array) -> pa.Array:
    names = [
        None if ch is None else "SPACE" if ch.isspace() else unicodedata.name(ch, "UNKNOWN")
        for ch in values.to_pylist()
    ]
    return pa.array(names, pa.string())


def char_name(col: Column) -> Column:
    """Unicode name of a character. For count tables, which are no longer than the alphabet."""
    return _unicode_name(col)


def apply_char_map(col: Column, char_map: Mapping[str, str]) -> Column:
    """Replace single characters. Entries whose key is not one character can never match."""
    char_map = {k: v for k, v in char_map.items() if len(k) == 1 and k != v}
    if not char_map:
        return col
    if all(len(v) == 1 for v in char_map.values()):
        return F.translate(col, "".join(char_map), "".join(char_map.values()))
    table = F.create_map(*[F.lit(s) for pair in char_map.items() for s in pair])
    chars = F.transform(F.split(col, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch))
    return F.array_join(chars, "")


def _quote(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def _quote_replacement(literal: str) -> str:
    return literal.replace("\\", "\\\\").replace("$", r"\$")


def suffix_attach(col: Column, suffix: str) -> Column:
    """Remove whitespace in front of every occurrence of ``suffix``."""
    suffix = unicodedata.normalize("NFC", suffix)
    if not suffix:
        return col
    return F.regexp_replace(col, f"[{WS}]+{_quote(suffix)}", _quote_replacement(suffix))


def suffix_detach(col: Column, suffix: str) -> Column:
    """Put a space in front of every occurrence of ``suffix`` that has none."""
    suffix = unicodedata.normalize("NFC", suffix)
    if not suffix:
        return col
    return F.regexp_replace(col, f"(?<![{WS}]){_quote(suffix)}", " " + _quote_replacement(suffix))


def normalize_text(
    col: Column,
    char_map: Mapping[str, str] | None = None,
    suffixes: list[tuple[str, bool]] | None = None,
    renormalize: bool = True,
) -> Column:
    """NFC, character map, NFC again when the map did something, then the suffix rules in order.

    ``suffixes`` holds ``(suffix, attach)``. ``renormalize=False`` leaves the second NFC out.
    """
    out = nfc(col)
    if char_map:
        out = apply_char_map(out, char_map)
        if renormalize:
            out = nfc(out)
    for suffix, attach in suffixes or []:
        out = suffix_attach(out, suffix) if attach else suffix_detach(out, suffix)
    return out
