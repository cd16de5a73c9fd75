import random
import sys
import unicodedata

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import bleu_tokens, chrf_words, tokens

from pairloom.functions import text as T

AWKWARD = [
    "", " ", " x ", "a\x1cb\x85c", "كٔ شُر", "éa", "٣٫١٤ ok", "…dots…", "(word)", "(word", "word)", "!?", "!",
    "3.14, 5-6 a-b U.S.A. ..5 a..5 1..5", "&quot;x&amp;y&lt;z&gt;&amp;lt;", "soft-\nbreak\nline -\n", "<skipped>a",
    "\U0001f600.\U0001f600,1", "don't 'quote' _under_", "a,b,,c,,,d 1,2,,3",
]


def both(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r[0] for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


@pytest.mark.parametrize(
    "expression, plain",
    [
        (T.tokenize, tokens),
        (T.chrf_words, chrf_words),
        (T.bleu_tokens, bleu_tokens),
        (T.words, str.split),
        (T.strip_text, str.strip),
        (T.drop_whitespace, lambda t: "".join(t.split())),
    ],
)
def test_expression_equals_python(spark, expression, plain):
    @settings(max_examples=2, deadline=None)
    @given(st.lists(st.text(alphabet="aé1.,-'!&;(ٔش \n\x85 \U0001f600", max_size=16), min_size=200, max_size=300))
    def check(texts):
        texts = texts + AWKWARD
        assert both(spark, texts, expression) == [plain(t) for t in texts]

    check()


def test_word_and_whitespace_classes_cover_every_code_point(spark):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    probe = points[::7] + [c for c in points if c.isspace()]
    assert both(spark, probe, T.strip_text) == [c.strip() for c in probe]
    assert set(T.WHITESPACE) == {c for c in points if c.isspace()}


def test_nfc(spark):
    texts = ["é", "Å", "آ", "üä", "plain", "가", "Å", "ạ̇"]
    assert both(spark, texts, T.nfc) == [unicodedata.normalize("NFC", t) for t in texts]


def test_suffix_rules(spark):
    assert both(spark, ["abab xab ab"], lambda c: T.suffix_detach(c, "ab")) == [" ab ab x ab ab"]
    assert both(spark, ["word \n ab c  ab"], lambda c: T.suffix_attach(c, "ab")) == ["wordab cab"]
    assert both(spark, ["x $1\\E y"], lambda c: T.suffix_attach(c, "$1\\E")) == ["x$1\\E y"]
    assert both(spark, ["a b"], lambda c: T.suffix_attach(T.suffix_detach(c, ""), "")) == ["a b"]


def test_char_map_and_order_of_rules(spark):
    assert both(spark, ["aée"], lambda c: T.apply_char_map(c, {"é": "e", "xy": "z"})) == ["aee"]
    assert both(spark, ["aßb"], lambda c: T.apply_char_map(c, {"ß": "ss", "b": ""})) == ["ass"]
    mapped = lambda again: both(spark, ["x́"], lambda c: T.normalize_text(c, {"x": "e"}, renormalize=again))
    assert mapped(True) == ["é"] and mapped(False) == ["é"]
    rules = [("b", True), ("c", False)]
    assert both(spark, ["a bc"], lambda col: T.normalize_text(col, None, rules)) == ["ab c"]


def test_labels_and_names(spark):
    assert both(spark, ["a", "ی", "\U0001f600"], T.codepoint_label) == ["U+0061", "U+06CC", "U+1F600"]
    assert both(spark, [" ", "a", ""], T.char_name) == ["SPACE", "LATIN SMALL LETTER A", "UNKNOWN"]
    assert both(spark, ["x"], lambda c: T.with_prefix(c, "p ")) == ["p x"]
    assert both(spark, ["x"], lambda c: T.with_prefix(c, "")) == ["x"]


def test_quick_check_sends_every_text_that_is_not_nfc(spark):
    """Every character on its own, with what it decomposes to, and among marks."""
    rng = random.Random(1)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    marks = [c for c in every if unicodedata.combining(c)]
    texts = [c for c in every if unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFD", c) != c or c in marks]
    texts += [unicodedata.normalize("NFD", c) for c in texts]
    texts += [rng.choice("aeوك가") + rng.choice(marks) + rng.choice(marks) for _ in range(4000)]
    texts += ["".join(rng.choice(every) for _ in range(4)) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfc(F.col("t")).alias("n"))
    assert [r for r in df.collect() if r.n != unicodedata.normalize("NFC", r.t)] == []


def test_arabic_text_in_nfc_stays_out_of_python(spark):
    texts = ["آزادی", "کٲشُر زبان", "قَلَم", "日本語テキスト", "Ελλάδα", "русский й", "한국어", "plain"]
    assert all(unicodedata.is_normalized("NFC", t) for t in texts)
    apart = ["ا\u0653زادی", "e\u0301", "\u1100\u1161", "ك\u064e\u0651", "\u212b"]
    df = spark.createDataFrame([(t,) for t in texts + apart], "t string")
    sent = [r[0] for r in df.select(T.needs_nfc(F.col("t"))).collect() if r[0] is not None]
    assert sent == apart
