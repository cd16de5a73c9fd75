"""Vector codes, byte-level BPE and spelling variants against brute force, SQL and another library."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken

from pairloom.llm import byte_bpe, spelling_variants, vector_codes
from pairloom.llm.queries import ORACLES, QUERIES


def sql_rows(name, folder):
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = db.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    return Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), sorted(names)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_spelling_variants"])
def test_equals_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    rows, names = sql_rows(name, small)
    assert sorted(df.columns) == names
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == rows


# --- vector codes


def brute_codes(rows):
    """{row: (code, error)}, label sums and the digest, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    width = max(1, -(-length // 16))
    whole = [[math.floor(256 * x) if abs(x) < 2**40 else 256 * int(x) for x in r[1]] for r in kept]
    whole = [v + [0] * (16 * width - length) if len(v) == length else None for v in whole]
    parts = [v and [v[p * width : (p + 1) * width] for p in range(16)] for v in whole]
    books = [[list(v[p]) for v in parts[:64] if v] for p in range(16)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(2):
        for p in range(16):
            members = {}
            for v in parts:
                if v:
                    members.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for e, group in members.items():
                books[p][e] = [sum(column) // len(group) for column in zip(*group)]
    out = []
    for r, v in zip(kept, parts):
        found = v and [near(v[p], books[p]) for p in range(16)]
        error = sum(d for d, _ in found) if v else None
        code = "".join(f"{e:02x}" for _, e in found) if v else None
        out.append((r[0], code, error if error is None or error < 2**63 else None, r[2]))
    sums = {}
    for _, _, error, label in out:
        sums[label] = None if error is None and label not in sums else (sums.get(label) or 0) + (error or 0)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, sums[label], digest) for i, code, error, label in out)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, key int, `a.b` int"
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).repartition(3)


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 40)], i % 3 if i % 5 else None) for i in range(150)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], 2), (None, rows[5][1], 2)]
    rows += [(200, None, 1), (201, [None] * 40, 1), (202, [float("nan")] * 40, 1), (203, [float("inf")] + [0.0] * 39, 1)]
    rows += [(204, [1.0, 2.0], 7), (205, [], 8), (206, [float(2**21)] * 40, 9), (207, [-float(2**100)] + [0.5] * 39, 10)]
    got = vector_codes.compress(vectors(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_codes(rows)
    few = [(i, [0.1 * i] * 16, 1) for i in range(3)]
    assert Counter(tuple(r) for r in vector_codes.compress(vectors(spark, few)).collect()) == brute_codes(few)
    assert vector_codes.compress(vectors(spark, rows).limit(0)).count() == 0


def test_nearest_is_exact_at_every_width():
    rng = np.random.default_rng(0)
    for width in (0, 1, 3, 4, 7, 48):
        for spread in (2, 1000):
            parts, entries = (rng.integers(-spread, spread, (n, width)) for n in (60, 20))
            entry, distance = vector_codes.nearest(parts, entries)
            every = ((parts[:, None] - entries) ** 2).sum(axis=2)
            assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    signs = vector_codes.transformed(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(row) != 0).sum() for row in signs] == list(range(8))  # by sequency


def test_codes_give_vectors_back(spark):
    rows = [(i, [0.01 * i * k for k in range(20)], 0) for i in range(30)]
    df = vectors(spark, rows).selectExpr("vec_id AS key", "embedding AS vector", "label")
    length, books = vector_codes.learn(df, rounds=0)
    coded = vector_codes.assign(df, length, books)
    back = {r.key: r.vector for r in vector_codes.decompress(coded, books, length).collect()}
    assert back == {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows}


# --- byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    texts = [None, "", " ", " \t\n", "a b", "x" * 3000, "Ünï　cødé\u0085 ﷽ <|endoftext|> it's\r\n\n end "]
    texts += ["\U0001f600 smile’s don’t", "abࡰc ൊ", " " * 500 + "a", "=" * 333, "  x", "12345678901234567890", "\0a\0"]
    for _ in range(400):
        alphabet = rng.choice(["abc", "aeiouxyzt", "= -_#", "xX ", "日本語テキスト漢", "".join(map(chr, range(32, 127)))])
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))))
    for _ in range(400):
        kinds = [(1, 0x2FF), (1, 0xD7FF), (0xE000, 0x1FFFF), (32, 32)]
        texts.append("".join(chr(rng.randint(*rng.choice(kinds))) for _ in range(30)))
    return [*texts, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))]


def test_byte_bpe_equals_another_library(spark, reference_encoding):
    texts = odd_texts()
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "two rows", "x", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, `ids` int").repartition(3)
    expected = Counter()
    for key, text, *_ in rows:
        ids = reference_encoding.encode_ordinary(text or "")
        packed = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        expected[key, len(ids), packed, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.digest(df).collect()) == expected


def test_frequent_words_change_nothing(spark, reference_encoding):
    texts = ["the enverachge schachlichie enverachge"] * 40 + ["wichtigkeitsbereich enverachge the the"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for words in (0, 2, 1000):
        for r in byte_bpe.encode(df, words=words).collect():
            assert r.ids == reference_encoding.encode_ordinary(r.text)
    ids = spark.createDataFrame([([],), (None,), ([0, None, 999_999, 11],)], "ids array<int>")
    assert [r.decoded for r in byte_bpe.decode(ids).collect()] == [b"", None, reference_encoding.decode_bytes([0, 11])]
    assert byte_bpe.encode(df.limit(0)).count() == 0


def test_byte_bpe_carries_no_words_in_its_plan(spark, reference_encoding):
    texts = [f"zq{i}vexing{i * 7919}wuggle kontrafibularities{i}" for i in range(3000)] + ["y" * 49 + "zx" * 700 + "ab" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = byte_bpe.encode(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "kontrafib" not in plan and len(plan) < 100_000  # the maps of words and tokens were literals of it
    assert all(r.ids == reference_encoding.encode_ordinary(r.text) for r in found.collect())


# --- spelling variants


def brute_variants(rows):
    counts = Counter()
    for key, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in lower + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] += len(word) >= 5
                run = ""
    words = {w: n for w, n in counts.items() if n >= 3}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        other = {w[:i] + w[i + 1 :] for i in range(len(w))}
        other |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        other |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = sorted((other - {w}) & set(words), key=lambda x: (-words[x], x))
    form = {w: x[0] if x and words[x[0]] >= 2 * words[w] else None for w, x in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, words[w], len(near[w]), form[w], form[w] and words[form[w]], root(w)) for w in words}


def test_spelling_variants(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "ababab"]
    rows = [(None, "Strasse strasse STRASSE Straße"), (1, None), (2, ""), (3, "x" * 5000 + " " + "x" * 4999), (3, "Ünter unter Ünter")]
    for i in range(1200):
        w = rng.choice(base[: 1 + i % 63])
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdeé") + w[at:], w[:at] + rng.choice("abcdeé") + w[at + 1 :]])
        rows.append((i % 7, f"{w}1{w.upper() if i % 2 else w}"))
    rows += [(3, "x" * 5000 + " " + "x" * 4999)] * 3
    rows += [(i, w) for w, n in (("katzenn", 4), ("katzen", 11), ("katten", 30)) for i in range(n)]  # a chain of forms
    schema = "doc_id long, text string, word string, n int, `a.b` int"
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).repartition(3)
    got = spelling_variants.group(df).select("word", "n", "n_near", "form", "form_n", "root").collect()
    expected = brute_variants(rows)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert sum(r[2] > 0 for r in expected) > 50 and any(r[5] != r[3] and r[3] for r in expected)
    assert spelling_variants.group(df.limit(0)).count() == 0


def test_pivots_meet_every_word_one_edit_away():
    rng = random.Random(5)
    for _ in range(3000):
        letters = rng.choice(["ab", "abcdefgh"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
        at = rng.randrange(len(a))
        b = rng.choice([a[:at] + a[at + 1 :], a[:at] + rng.choice(letters) + a[at:], a[:at] + rng.choice(letters) + a[at + 1 :]])
        if a == b or len(b) < 5:
            continue
        grams = sorted({w[i : i + 2] for w in (a, b) for i in range(len(w) - 1)}, key=lambda g: rng.random())
        ranks = {g: (i, rng.randint(1, 9)) for i, g in enumerate(grams)}
        (ours, last), (theirs, other) = spelling_variants.pivot_keys(a, ranks), spelling_variants.prefix_keys(b, ranks)
        if last <= other:
            assert ours & theirs, (a, b)
        places = spelling_variants.pivots_of(a, spelling_variants.prefix_of(a, ranks)[0], ranks)
        assert len(places) == 2 and places[1] - places[0] >= 2
