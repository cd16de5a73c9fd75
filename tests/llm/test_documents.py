"""Operators on documents against brute force: nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from pairloom.llm import (
    decontaminate,
    graphs,
    language_id,
    ngram_join,
    packing,
    quality_rules,
    secret_scan,
    substring_dedup,
    toxicity,
    words,
)
from pairloom.llm.tables import having, key_marks

# clashing names: what operators call their own columns
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, one int, score string, ids string"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a B"),
    (5, "A b"),
    (6, BASE),
    (7, BASE),
    (7, BASE),
    (8, BASE + " more"),
    (9, BASE.upper()),
    (10, "ha " * 60),
    (11, "ab cd " * 40),
    (12, "x" * 50_000),
    (13, " ".join(f"v{i}" for i in range(20_000))),
    (14, "Ünï\u3000cødé\u0085 ﷽ <|endoftext|> it's\r\n\n end "),
    (None, "one two three four"),
    (None, "one two three four"),
    (15, " ".join(["q"] * 20 + [f"v{i}" for i in range(40)])),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or ""), "k", 1, "s", "i") for k, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars").cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words_of(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_quality_counts(docs, nothing):
    def expected(text):
        w = words_of(text)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
        lines = [line for line in (text or "").split("\n") if words_of(line)]
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)

    rows = quality_rules.judge(docs).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[f] for f in fields)) for r in rows) == Counter((k, *expected(t)) for k, t in TEXTS)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing).count() == 0


def test_quality_uses_no_python_on_executors(docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_weak_supervision_rejects_each_kind_of_bad_text(spark):
    clean = [" ".join(f"word{(i * 7 + j * j) % 997}" + "." * (j % 9 == 8) for j in range(80)) for i in range(200)]
    bad = [" ".join(f"w{i}{j}***" for j in range(80)) + "." for i in range(15)] + ["same " * 70] * 15
    df = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.judge(df).where("kept").collect()}
    assert kept == set(range(200))


def test_ngram_join(docs, nothing, spark):
    def sets(text):
        w = words_of(folded(text))
        return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()

    own = [sets(t) for _, t in TEXTS]
    near = [[100 * len(a & b) >= 90 * len(a | b) and bool(a) for b in own] for a in own]
    reached = []
    for i in range(len(own)):
        seen, todo = {i}, [i]
        while todo:
            new = {j for j in range(len(own)) if near[todo[-1]][j]} - seen
            todo.pop()
            todo += new
            seen |= new
        keys = [TEXTS[j][0] for j in seen if TEXTS[j][0] is not None]
        reached.append(min(keys, default=None))
    expected = Counter((k, len(s), c) for (k, _), s, c in zip(TEXTS, own, reached, strict=True))
    assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == expected
    assert ngram_join.join(nothing).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    left = Counter(r.doc_id for r in kept.collect())
    assert left == Counter({k: 1 for k in (1, 2, 3, 4, 6, 10, 11, 12, 13, 14, 15, None)})


def test_ngram_join_finds_every_link_of_a_group_of_near_copies(spark):
    base = [f"b{i}" for i in range(120)]

    def edited(n):
        text = list(base)
        for j in range(n % 5):
            text[(n * 31 + j * 17) % 120] = f"e{n}x{j}"
        return " ".join(text)

    texts = [edited(n) for n in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for t in texts]
    links = spark.createDataFrame(
        [(i, j) for i in range(300) for j in range(i) if 100 * len(own[i] & own[j]) >= 90 * len(own[i] | own[j])],
        "a long, b long",
    )
    expected = {i: i for i in range(300)} | {r.node: r.component for r in graphs.components(links).collect()}
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == expected


def test_ngram_join_gives_no_more_candidates_than_members_of_a_group_near_the_bar(spark, monkeypatch):
    base, rng = [f"b{i}" for i in range(150)], random.Random(5)

    def edited(n):
        text = list(base)
        for j in range(rng.randrange(1, 5)):
            text[rng.randrange(150)] = f"e{n}x{j}"
        return " ".join(text)

    texts = [edited(n) for n in range(240)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for t in texts]
    links = [(i, j) for i in range(240) for j in range(i) if 100 * len(own[i] & own[j]) >= 90 * len(own[i] | own[j])]
    reached = graphs.components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {i: i for i in range(240)} | {r.node: r.component for r in reached}
    staged, written = {}, ngram_join.stage

    def noted(df, what):
        staged[what] = written(df, what)
        return staged[what]

    monkeypatch.setattr(ngram_join, "stage", noted)
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == expected
    assert len(set(expected.values())) > 1 and len(links) > 1000
    assert 0 < staged["join-rest"].count() < 3 * 240  # of each tile of two blocks a forest, not all pairs


def test_components_join_fewer_edges_in_every_round(spark, monkeypatch):
    rng, above = random.Random(7), {}
    star = [(500 + rng.randrange(3), n) for n in range(500)] * 4
    edges = star + [(n, n + 1) for n in range(1000, 1300)] + [(7, 7), (2000, 2000), (2001, -3)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    rows, written = [], graphs.stage

    def noted(df, what):
        out = written(df, what)
        if what == "edges":
            rows.append(out.count())
        return out

    monkeypatch.setattr(graphs, "stage", noted)
    found = graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in above} and len(found) == len(above)
    assert rows[-1] == 0 and rows[1:] and sum(rows[1:]) < rows[0] < len(edges) / 2  # in all, less than the first again


def test_ngram_join_signs_once_with_a_rare_token_and_streams_groups(spark):
    tokens = np.arange(1, 61, dtype=np.uint64)  # linked sets have 48 to 75 tokens: two size ranges
    found, meant = ngram_join.signatures(tokens, np.zeros(60, bool), 80)
    assert len(found) == 13 and set(meant) == {2**5 + 2**6}
    rows = [(s, 1 + s % 3, n) for s in range(-20, 20) for n in range(s % 4) for _ in range(s % 3 + 1)]
    rows += [(99, 2, n) for n in range(25_000)] + [(98, n % 3 + 1, n) for n in range(6)]
    df = spark.createDataFrame(rows, "signature long, meant long, one long").repartition(5)
    groups = defaultdict(set)
    for s, meant, n in rows:
        for size in range(2):
            if meant >> size & 1:
                groups[s, size].add(n)
    expected = Counter((n, min(g), max(g)) for g in groups.values() if len(g) > 1 for n in g)
    members = ngram_join.shared(df, 3).collect()
    assert Counter((r.one, r.low, r.high) for r in members) == expected
    assert len({r.signature for r in members}) == sum(len(g) > 1 for g in groups.values())


def test_ngram_join_signs_with_the_rarest_tokens_and_shuffles_few_texts(spark, monkeypatch):
    common = " ".join(f"c{i}" for i in range(100))
    texts = [f"{common} " + " ".join(f"o{n}x{i}" for i in range(100)) for n in range(50)]
    texts += [texts[0] + " more", texts[0] + " more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    staged, written = {}, ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, what: staged.setdefault(what, written(df, what)))
    found = {r.doc_id: r.component_id for r in ngram_join.join(df).collect()}
    assert found == {n: 0 if n >= 50 else n for n in range(52)}
    assert "join-signatures" not in staged  # they are shuffled once and not written
    # the 50 texts share 98 shingles, but only the two classes that link meet under a signature
    assert staged["join-members"].select("one").distinct().count() == 2
    assert staged["join-wanted"].count() == 2  # whose texts alone are shuffled
    monkeypatch.undo()
    assert {r.doc_id for r in ngram_join.one_of_each(df).collect()} == set(range(50))


def test_key_marks_keep_every_marked_key_and_few_others(spark):
    df = spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id")).alias("a.b"), F.lit("t").alias("t"))
    marks = key_marks(df.where("`a.b` is null or `a.b` % 100 = 1"), "a.b")
    kept = having(df, "a.b", marks)
    assert kept.where("`a.b` is null or `a.b` % 100 = 1").count() == 1001
    assert kept.count() < 1100 and kept.count() + having(df, "a.b", marks, False).count() == 100_000
    assert having(df, "a.b", key_marks(df.limit(0), "a.b")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 500)]
    found = {r.node: r.component for r in graphs.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_substring_dedup(docs, nothing):
    own = [words_of(t) for _, t in TEXTS]
    at = defaultdict(list)
    for i, w in enumerate(own):
        for j in range(len(w) - 34):
            at[tuple(w[j : j + 35])].append((i, j))
    gone = [set() for _ in own]
    for places in at.values():
        if len(places) > 1:
            for i, j in places:
                gone[i].update(range(j, j + 35))
    expected = Counter()
    for (k, _), w, g in zip(TEXTS, own, gone, strict=True):
        kept = " ".join(x for j, x in enumerate(w) if j not in g)
        expected[(k, len(w), len(g), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring_dedup.dedup(docs).collect()) == expected
    assert substring_dedup.dedup(nothing).count() == 0


def test_substring_dedup_hashes_a_window_in_a_few_steps_and_keeps_words_by_bytes():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in (3, 9, 35, 199, 200):
        slow = [sum(int(h[i + j]) * pow(int(words.CHAIN), j, 1 << 64) for j in range(size)) % (1 << 64) for i in range(200 - size)]
        assert (words.chained(h, size) == words.mix(np.array(slow, np.uint64))).all()
    texts = [b" a  bc\td ", b"", b"\n", b"e", "ü f\n".encode()]
    bounds, data = np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)
    gone = np.array([False, True, False, True, False, False])
    kept, ends, n, lost = substring_dedup.kept_bytes(data, bounds, lambda cuts: gone)
    assert [kept[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] == [b"a d", b"", b"", b"", "ü f".encode()]
    assert (n.tolist(), lost.tolist()) == ([3, 0, 0, 1, 2], [1, 0, 0, 1, 0])


def test_packing(docs, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pieces = packing.pack(docs, with_ids=True)
    rows = sorted(pieces.collect(), key=lambda r: (r.doc_id or 0, r.start))
    expected = Counter()
    for k, t in TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        expected[(k, len(ids), sum(ids))] += 1
    total, found = Counter(), Counter()
    for r in rows:
        assert zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32 and len(r.ids) == r.length
        total[(r.doc_id, r.doc_tokens)] += r.length
        found[(r.doc_id, r.doc_tokens)] += sum(r.ids)
    want = Counter()
    for (k, n, s), times in expected.items():
        want[(k, n)] += s * times
    assert found == want
    assert total == Counter({kn: kn[1] * sum(c for (k, n, _), c in expected.items() if (k, n) == kn) for kn in want})
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == 1024 or at.bit_count() == 1
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert all(len(r.ids) == r.n_ids for r in whole.values()) and set(whole) == set(by_sequence)
    assert packing.pack(nothing).count() == 0


def test_packing_holds_one_result_of_the_tokenizer_and_little_of_a_chunk():
    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer, self.most = tokenizer, 0

        def encode(self, text, **options):
            self.most = max(self.most, 1)
            return self.tokenizer.encode(text, **options)

        def encode_batch(self, texts, **options):
            self.most = max(self.most, len(texts))
            return self.tokenizer.encode_batch(texts, **options)

    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    encoder.tokenizer = Watched(encoder.tokenizer)
    texts = [" ".join(f"w{i * i}x" for i in range(a, a + 2000)) for a in (0, 1000, 4000)]
    texts += ["", " ".join(f"v{i}" for i in range(3000))]
    for some in (texts[:2], texts[2:], texts):  # learnt, learnt beside what is known, all known
        raw = [t.encode() for t in some]
        data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        ids, cuts = encoder.encode(data, bounds)
        want = [[*encoder.tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in some]
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want
    assert encoder.tokenizer.most == 1
    kept = sum(a.nbytes for a in vars(encoder).values() if isinstance(a, np.ndarray))
    assert kept <= 20 * len(encoder.hashes) + 2 * len(encoder.ids) + 8 and len(encoder.hashes) > 7000


def test_neighbours_on_the_curve_are_neighbours_in_space():
    import numpy as np

    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(points, bits=3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_secrets(spark, docs, nothing):
    key = "AKIA" + "ABCDEFGH12345678"
    strong = "q7Zp9x-Kd83_sLw02Vb5RtY1"
    rows = [
        (1, f"é password = 'hunter2hunter2' and {key}", [("assign", 2, 28), ("access", 34, 54)]),
        (2, "PASSWORD:short api_key:abcdefgh", [("assign", 15, 31)]),
        (3, "id " + "0a" * 20 + " " + "f" * 31, [("hex", 3, 43)]),
        (4, f"the client_id of the login was {strong} then", [("novel", 31, 31 + len(strong))]),
        (5, "the login and password pages of the corporation were internationalisation work", []),
        (6, "paſſword = abcdefghij", []),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    for k, _, spans in rows:
        spans = [f"{kind}:{a}:{b}" for kind, a, b in spans]
        base = ",".join(s for s in spans if not s.startswith("novel"))
        assert found[k].spans == ",".join(spans), k
        assert found[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean[1] == "é [SECRET]' and [SECRET]" and clean[5] == rows[4][1]
    assert Counter(r.doc_id for r in secret_scan.scan(docs).collect()) == Counter(k for k, _ in TEXTS)
    same = secret_scan.redact(docs, length="n_chars")
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert secret_scan.scan(nothing).count() == 0


def test_secrets_of_one_class_and_before_their_word(spark):
    words = ["the login and password pages of the corporation were internationalisation work", "Responsibilities of a session: characterisation, //www.example.com/session/overview and get_connection_parameters"]
    secrets = ["904817263550", "73920518463329018475", "qzkxvjwpmtrbgh", "xkqjvzwhfpbdmgcyrlnt", "QZKXVJWPMTRBGH", "q7Zp9x-Kd83_sLw02Vb5RtY1"]
    forms = ["the session login was {} then", "{} is the password of it", "they wrote {} down, and it was the login"]
    texts = words + [form.format(s) for form in forms for s in secrets]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert [clean[k] for k in range(len(texts))] == words + [form.format("[SECRET]") for form in forms for _ in secrets]


def test_language(spark, docs, nothing):
    kinds = {"xx": "lorem dolar sitame", "yy": "þþer öä grüß"}
    rows = [(i, " ".join([kinds[k]] * (3 + i % 5)), k) for i in range(60) for k in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame([*rows, (100, None, "xx"), (101, "12 34!", "yy"), (None, "dolar", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(found[i].lang_pred == k for i, _, k in rows) and all(0 <= r.score <= 1 for r in found.values())
    assert found[100].lang_pred == found[101].lang_pred == "und" and found[None].held_out is False
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    kept = language_id.known_language(docs)
    assert kept.columns == docs.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.identify(nothing).count() == language_id.known_language(nothing).count() == 0


def test_gradients_of_the_network():
    import numpy as np

    rng = np.random.default_rng(0)
    network = language_id.new_network(["a", "b"], hidden=3)
    for p in network.parameters():
        p[...] = p * 0.3
    codes, labels, weight = rng.integers(97, 100, (5, 4)), np.array([0, 1, 0, 1]), np.ones((5, 4), np.float32)

    def loss():
        p = language_id.position_probabilities(network, codes)
        return -np.log(p[:, labels, np.arange(4)]).mean()

    for p, g in zip(network.parameters(), language_id.gradients(network, codes, labels, weight), strict=True):
        i = tuple(np.unravel_index(np.abs(g).argmax(), p.shape))
        old, step = p[i], np.float32(1e-2)
        p[i] = old + step
        up = loss()
        p[i] = old - step
        down = loss()
        p[i] = old
        assert abs((up - down) / (2 * step) - g[i]) < 0.02 * abs(g[i]) + 1e-3


def test_toxicity(spark, docs, nothing):
    mild = "the report of the council was read and the members went home"
    before = ("great", "small", "old", "new", "loud", "quiet", "such", "some", "odd", "slow", "very", "most")
    rows = [
        (i, f"{mild} {before[i % 11]} {('grumble', 'grumbler')[i % 2]}" if i % 3 == 0 else f"{mild} {i % 7} times", int(i % 3 == 0))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = {r.doc_id: r for r in toxicity.judge(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    assert all(found[i].predicted == label for i, _, label in rows)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.judge(docs, labels).collect()} == {0.0}
    assert toxicity.judge(nothing, labels).count() == 0


def test_a_repeated_id_does_not_widen_the_samples(spark, tmp_path):
    rows = [(1, f"text number {i} of one id", "en", 0) for i in range(500)] + [(1, "the same text", "en", 0)] * 500
    rows += [(i, f"other words {i}", "de", 1) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(5, "text")
    staged = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "stage", lambda sample, what: staged.append(sample) or sample)
        toxicity.learn(df.drop("toxic"), df.select("doc_id", "toxic"), F.lit(True), most=100)
    assert Counter(r.label for r in staged[0].collect()) == {0: 100, 1: 58}
    assert staged[0].where("text = 'the same text'").count() <= 1
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "SAMPLE", 40)
        drawn = [language_id.excerpts_of(d, "doc_id", "text", "lang", F.lit(True)) for d in (df, df.repartition(2, "text"))]
    texts = [raw for raw, lang in drawn[0] if lang == "en"]
    assert drawn[0] == drawn[1] and len(texts) in (0, 40) and len(texts) == len(set(texts))


def test_stages_keep_columns_with_dots(spark, docs):
    benchmark = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    wide = docs.withColumn("a.b", F.lit(1)).withColumn("`c`.d", F.array(F.lit("x")))
    steps = {
        "language": lambda df: language_id.known_language(df, least=0.0),
        "near copies": lambda df: ngram_join.one_of_each(df, k=5, percent=80),
        "leaks": lambda df: decontaminate.without_leaks(df, benchmark),
        "secrets": lambda df: secret_scan.redact(df, length="n_chars"),
    }
    for step in steps.values():
        kept = step(wide)
        assert kept.columns == wide.columns
        same = step(docs)
        assert sorted(map(str, (r[: len(docs.columns)] for r in kept.collect()))) == sorted(map(str, map(tuple, same.collect())))


def test_the_grammar_weighs_clauses():
    lexicon = toxicity.Lexicon(words={"fool": 4.0}, stems={"imbe": 3.0})
    score = lambda text: toxicity.text_features(text, lexicon)[0]
    assert score("You fool.") > score("A fool.") > score("Not a fool.") > 0 == score("A tool.")
    assert score("He said a fool came.") < score("He had a fool come.")
    assert score("An imbecile.") > 0 and score("I will kill you.") > 0 == score("They kill time.")


def test_leaks(spark, docs, nothing):
    items = ["the quick brown fox jumps over the lazy dog near the old river bank at dawn. It was grey.", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron", None, "", "..."]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(100))
    changed = items[0].replace("lazy", "sleepy").replace("near", "by")
    rows = [(1, f"{filler} {items[0]} {filler}"), (2, f"{filler} {changed} {filler}"), (3, filler), (4, None), (5, items[1].upper()), (6, " ".join(reversed(items[1].split())))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()}
    assert found == {(1, 0), (2, 0), (5, 1)}
    assert {r.doc_id for r in decontaminate.without_leaks(df, benchmark).collect()} == {3, 4, 6}
    kept = decontaminate.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(nothing, benchmark).count() == 0


def planted_items(spark, n, length, replaced):
    """A benchmark of n items over a shared vocabulary; each is in one document, with some of its words replaced."""
    import numpy as np

    rng = np.random.default_rng(n + length)
    items = [[f"w{w}" for w in rng.integers(0, 3000, length)] for _ in range(n)]
    docs = []
    for k, item in enumerate(items):
        words = [f"x{k}y{j}" if rng.random() < replaced else w for j, w in enumerate(item)]
        filler = [f"f{w}" for w in rng.integers(0, 3000, 80)]
        docs.append((k, " ".join(filler[: k % 80] + words + filler[k % 80 :])))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache(), benchmark


def covered_items(docs, benchmark):
    """(document, item) of every pair whose whole texts have enough words in order, by brute force."""
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in benchmark.collect()]
    owners = defaultdict(Counter)
    for i, words in items:
        for w in set(words.tolist()):
            owners[w][i] += 1
    found = set()
    for r in docs.collect():
        words = decontaminate.words_of(r.text)
        shared = Counter()
        for w in set(words.tolist()):
            shared.update(owners.get(w, ()))
        for i, item in items:
            if shared[i] >= 0.3 * len(set(item.tolist())):
                if decontaminate.common_subsequence(item, words) >= decontaminate.SURE * len(item):
                    found.add((r.doc_id, i))
    return found


@pytest.mark.parametrize(("n", "replaced"), [(300, 0), (600, 0.15)])
def test_no_item_of_a_large_benchmark_is_lost(spark, n, replaced):
    docs, benchmark = planted_items(spark, n, 40, replaced)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    wanted = covered_items(docs, benchmark)
    assert len(wanted) >= (0.6 if replaced else 1) * n
    assert wanted <= found
    leaking = {d for d, _ in found}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()} == set(range(n)) - leaking


def test_the_length_of_an_item_does_not_matter(spark):
    for n, length in ((30, 700), (30, 400), (30, 2), (30, 5)):
        docs, benchmark = planted_items(spark, n, length, 0)
        found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
        assert {(k, k) for k in range(n)} <= found, length


def test_common_subsequence():
    import numpy as np

    assert decontaminate.common_subsequence(np.array([1, 2, 3, 4]), np.array([9, 2, 1, 3, 3, 4])) == 3
    assert decontaminate.common_subsequence(np.array([1, 1]), np.array([1])) == 1
    assert decontaminate.common_subsequence(np.array([5]), np.array([], int)) == 0
