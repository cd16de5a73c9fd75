"""Page operators, the registered queries against SQL, and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import queries, url_filter, warc
from tools.check_oracles import rows_of

PAGES = "page_id long, url string, html string, record_type string, key int"


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, db, name):
    df = queries.QUERIES[name](spark, small)
    result = db.execute(queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in result.description], result.fetchall())


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "a\nb", ""), (4, "u", None), (None, "u", "same"), (5, "ü", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 300_000), (1, "u", "same")]
    pages = spark.createDataFrame([(*r, "odd", 1) for r in rows], PAGES)

    def digest(html):
        return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()

    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    expected = []
    for k, _, html in rows:
        own = first[html or ""]
        expected.append((k, len((html or "").encode()), digest(html), "response" if k == own else "revisit", None if k == own else own))
    assert sorted(map(str, map(tuple, warc.round_trip(pages).collect()))) == sorted(map(str, expected))
    folder = str(tmp_path / "w")
    warc.write_pages(pages, folder, max_file_bytes=200)
    assert len(list(Path(folder).glob("part-*.warc.gz"))) >= 3 and not list(Path(folder).glob(".*.gz"))
    back = warc.read_archives(spark, folder).where("record_type = 'response' and record_id = 'urn:page:5'").collect()
    assert [(bytes(r.payload).decode(), r.target_uri) for r in back] == [(rows[5][2], "ü")]
    assert warc.read_archives(spark, folder, payload=False).columns[-1] == "payload_bytes"
    assert warc.round_trip(pages.limit(0)).count() == 0
    few = warc.page_records(pages, least=5).where("record_type = 'revisit'")
    assert few.count() == 0


def test_pushed_predicates_skip_records_before_their_payload(spark, tmp_path):
    seen = []
    head = {"record_type": "response", "record_id": "urn:page:1", "refers_to": None, "target_uri": None, "payload_digest": None}
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.record(head, b"x" * 99_999)) + warc.member(warc.record({**head, "record_id": "urn:page:2"}, b"y")))
    for row in warc.records(warc.fs.LocalFileSystem(), str(tmp_path / "a.warc.gz"), {"record_id": {"urn:page:2"}}, True, True):
        seen.append((row["record_id"], row["payload"]))
    assert seen == [("urn:page:2", b"y")]


def foreign(kind, record_id, block, content_type="application/http; msgtype=response", digest=None, uri="http://x/"):
    """A record as other writers make it, without a payload length."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID:<{record_id}>", "WARC-Target-URI:", f" {uri}", f"Content-Type: {content_type}"]
    lines += [f"WARC-Payload-Digest: {digest}"] if digest else []
    return "\r\n".join([*lines, f"content-length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n"
BODY = b"body\r\n\r\nWARC/1.0\r\n" * 20_000
FOREIGN = [
    foreign("warcinfo", "i", b"software: s\r\n", "application/warc-fields", uri=""),
    foreign("request", "q", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "application/http; msgtype=request"),
    foreign("response", "r", HTTP + BODY, digest="sha1:" + warc.digest_of(BODY)),
    foreign("response", "hex", HTTP + b"y", digest="SHA1:" + hashlib.sha1(b"y").hexdigest()),
    foreign("response", "chunks", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\ny\r\n0\r\n\r\n", digest="sha1:" + warc.digest_of(b"y")),
    foreign("revisit", "v", HTTP),
    foreign("resource", "file", b"plain bytes", "text/plain", digest="sha256:00"),
    foreign("metadata", "empty", b"", "text/plain"),
]
PAYLOADS = [
    ("i", b"software: s\r\n"), ("q", b""), ("r", BODY), ("hex", b"y"), ("chunks", b"1\r\ny\r\n0\r\n\r\n"), ("v", None), ("file", b"plain bytes"), ("empty", b""),
]


@pytest.mark.parametrize("payload", [True, False])
def test_archives_of_other_writers(spark, tmp_path, payload):
    own = {"record_type": "response", "record_id": "own", "refers_to": None, "target_uri": "http://x/", "payload_digest": None}
    zero = bytearray(warc.member(FOREIGN[0]))
    zero[16:20] = bytes(4)  # a length of nothing
    files = {
        "members.warc.gz": b"".join(map(gzip.compress, FOREIGN)),
        "one_member.warc.gz": gzip.compress(b"".join(FOREIGN)),
        "plain.warc": b"".join(FOREIGN),
        "with_lengths.warc.gz": b"".join(map(warc.member, FOREIGN)),
        "beyond_32_bits.warc.gz": b"".join(warc.member(r, most=100) for r in FOREIGN),
        "mixed.warc.gz": warc.member(warc.record(own, b"z")) + bytes(zero) + b"".join(map(gzip.compress, FOREIGN[1:])),
        "empty.warc": b"",
        "other.txt": b"no archive",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    expected = sorted([(k, None if p is None else len(p), p if payload else None) for k, p in PAYLOADS] * 6 + [("own", 1, b"z" if payload else None)], key=str)
    whole = warc.read_archives(spark, str(tmp_path), payload=payload, verify=payload)
    found = [(r.record_id, r.payload_bytes, r.payload and bytes(r.payload) if payload else None) for r in whole.collect()]
    assert sorted(found, key=str) == expected
    one = warc.read_archives(spark, str(tmp_path / "plain.warc"), payload=payload).where("record_type in ('resource', 'none')")
    assert [(r.record_id, r.target_uri, r.payload_digest) for r in one.collect()] == [("file", "http://x/", "00")]


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_broken_archives_raise(tmp_path, name):
    pack = gzip.compress if name.endswith("gz") else bytes
    bad = [pack(FOREIGN[2])[:-300], pack(b"hello\r\n\r\n"), pack(FOREIGN[3].replace(b"\r\ny\r\n", b"\r\nx\r\n"))]
    for raw in bad:
        (tmp_path / name).write_bytes(raw)
        with pytest.raises((ValueError, EOFError)):
            list(warc.records(warc.fs.LocalFileSystem(), str(tmp_path / name), {}, True, True))
    (tmp_path / name).write_bytes(bad[0])
    with pytest.raises((ValueError, EOFError)):  # also where the payload is skipped
        list(warc.records(warc.fs.LocalFileSystem(), str(tmp_path / name), {"record_id": {"none"}}, False, False))


def test_urls(spark):
    urls = ["https://A.net/x", "http://www.Example.NET/en/1?q#f", "ftp://example.com/de/2", "x://b.org/fr/", "x://net", "no host", None, "x://notnet/en/", "x://é.org/de/3?u=1", "x://example.net/enx"]
    train = [f"http://h{i}.net/{'bad' if i % 2 else 'worse'}/{i}" for i in range(30)] + [f"http://h{i}.org/fr/good/{i}" for i in range(30)]
    rows = [(i, u, "h", "r", 1) for i, u in enumerate([*urls, *train, "http://z.com/good/9", "http://z.com/bad/8"])]
    found = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    expected = [("a.net", "/x", "net/"), ("www.example.net", "/en/1", "example.net/en/"), ("example.com", "/de/2", "example.com/de/"), ("b.org", "/fr/", "org/fr/"), ("net", "", None), ("", "", None), ("", "", None), ("notnet", "/en/", None), ("é.org", "/de/3", None), ("example.net", "/enx", "net/")]
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(len(urls))] == expected
    assert [found[i].verdict for i in (0, 1, 2, 3, 5, 6, 9)] == ["block", "allow", "block", "allow", "allow", "allow", "block"]
    assert len(found) == len(rows) and all(r.verdict in ("allow", "block") for r in found.values())
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_combinations_of_four_tokens_become_rules(spark):
    four = ["a", "b", "c", "d"]
    rows = [(four, "block")] * 30 + [([t for t in four if t != out], "allow") for out in four for _ in range(20)]
    rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert [(r["tokens"], r["verdict"], r["n"], r["c"]) for r in rules if r["verdict"] == "block"] == [(four, "block", 30, 1.0)]


def best_by_brute_force(rows, own, least, confidence):
    """(confidence, n, verdict) of the best of all combinations of tokens that ``own`` holds."""
    total, best = len(rows), None
    usable = [t for t in own if sum(t in have for have, _ in rows) <= url_filter.COMMON * total]
    for size in range(1, len(usable) + 1):
        for wanted in itertools.combinations(usable, size):
            verdicts = [v for have, v in rows if set(wanted) <= set(have)]
            for verdict in set(verdicts):
                n = verdicts.count(verdict)
                if n >= least and n >= confidence * len(verdicts):
                    found = (n / len(verdicts), len(verdicts), verdict)
                    best = max(best, found) if best else found
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_equal_those_of_a_brute_force_miner(spark, seed):
    draw = random.Random(seed)
    rows = []
    for _ in range(60):
        have = [t for t, p in zip("abcdefg", (0.5, 0.5, 0.3, 0.6, 0.2, 0.9, 1.0), strict=True) if draw.random() < p]
        have += ["d2", "d3"] if "d" in have else []  # always together
        rows.append((have, "block" if ("a" in have and "b" in have) != (draw.random() < 0.1) else "allow"))
    rows += [(["only", *"abc"], "allow")] * 3 + [([], "block")]
    decided = spark.createDataFrame(rows, "tokens array<string>, verdict string").repartition(3)
    known = url_filter.frequent_tokens(decided, 0.05)
    assert known[1:] == (4, 64) and known[0]["d3"][0] == "d"
    index = url_filter.indexed(url_filter.mine(decided, 0.05, 0.8, known))
    for _ in range(100):
        own = [t for t in [*"abcdefg", "d2", "d3", "only", "new"] if draw.random() < 0.4]
        verdict, c = url_filter.matched(index, [known[0].get(t, (t,))[0] for t in own])
        best = best_by_brute_force(rows, own, 4, 0.8)
        assert (verdict, c) == (("allow", None) if best is None else (best[2], pytest.approx(best[0])))


def test_long_urls_and_templates_of_many_tokens(spark):
    names = "&".join(f"q{i}=1" for i in range(40))
    urls = [f"http://h.net/p{i % 7}" for i in range(50)] + [f"http://h.net/p?{names}", "x://h.net/" + "ab/" * 4000]
    urls += [f"http://{'h' if i % 3 else 'g'}.org/fr/t?{names}" for i in range(20)] + [f"http://h.net/t?{names}" for i in range(20)]
    urls += [f"http://other.com/x?{names}", "http://g.com/"]
    rows = [(i, u, "h", "r", 1) for i, u in enumerate(urls)] + [(0, urls[0], "h", "r", 1)]  # one row twice
    start = time.monotonic()
    found = url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert time.monotonic() - start < 60
    verdicts = {r.page_id: r.verdict for r in found}
    assert len(found) == len(rows) and [verdicts[i] for i in (0, 50, 51, 52, 72)] == ["block", "block", "block", "allow", "block"]
    assert verdicts[len(urls) - 1] == "allow"  # g is allowed alone


def test_the_best_contained_rule_decides():
    rules = [
        {"tokens": ["a"], "verdict": "block", "n": 10, "c": 0.9},
        {"tokens": ["a", "b"], "verdict": "block", "n": 5, "c": 0.9},
        {"tokens": ["a", "c"], "verdict": "allow", "n": 5, "c": 1.0},
    ]
    index = url_filter.indexed(rules)
    assert sum(map(len, index.values())) == 2  # the second follows from the first
    assert url_filter.matched(index, ["a", "b"]) == ("block", 0.9)
    assert url_filter.matched(index, ["c", "a"]) == ("allow", 1.0)
    assert url_filter.matched(index, ["c"]) == ("allow", None)


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        step(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * seen[0]
    whole = corpus_pipeline.run(spark, small)
    assert whole.columns == docs.columns and whole.count() == docs.count()


def test_the_pipeline_keeps_one_of_each_group_of_near_copies(spark, small):
    base = [f"b{i}" for i in range(50)]
    texts = [" ".join(base), " ".join(base[:25] + ["new"] + base[26:]), " ".join(base[:20] + ["p", "q"] + base[40:]), "other words stand here today"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts, 10**6)]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    ids, sets = [], []
    for r in docs.collect():
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if x]
        ids.append(r.doc_id)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for k, g in zip(ids, group, strict=True):
        least[g] = min(k, least.get(g, k))
    step = dict(corpus_pipeline.STAGES)["ngram_join"]
    assert sorted(r.doc_id for r in step(spark, docs, small).collect()) == sorted(least.values())
    assert 10**6 + 1 not in least.values() and 10**6 + 2 in least.values()


def test_empty_tables_pass_the_pipeline(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
