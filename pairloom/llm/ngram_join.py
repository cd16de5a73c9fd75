"""Self-join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

The tokens of a document are its distinct shingles of ``k`` lower-cased words. Two documents link when their sets
have a similarity of at least ``percent``; the result gives each document the smallest id that links reach.

1. Documents with equal sets form a class and are one from here on.
2. A table of counts (COUNTERS hashed counters over all documents) orders tokens, least counted first, and parts rare
   from frequent ones; any order that is the same for all documents gives the same result.
3. A set of n tokens misses at most t = n - ceil(percent * n) tokens of a partner. Its prefix in this order is
   extended until t missing tokens cannot spoil all its signatures: a rare token is a signature by itself, a frequent
   one only together with another frequent one of the same subclass, so p tokens of a subclass survive p - 2 losses.
   Documents that link share a signature. Subclasses keep the pairs in proportion to the prefix; their number
   depends on the size range of the set, and a set near the end of a range also signs for the next: a rare token does so
   in one row, which tells its ranges.
4. Documents that share a signature are compared, but not all with all. First everyone is compared with the smallest
   and the largest member under the signature; a group of close copies then is one component. Only members that are
   still in different components are compared with each other, in tiles of two blocks of members, which loses no link
   between components. Before sets are fetched, a parity bitmap of a few bits for each token that linked sets may
   differ in rules out most pairs: each bit in which two bitmaps differ takes a token in which the sets differ. Pairs that
   are left do not leave a tile: it gives a spanning forest of them, of at most one row for each member, and what all
   forests connect is a cluster. The sets of a cluster meet in tiles again, which give a spanning forest of the links.

Signatures are shuffled once and not staged, and their groups are read from sorted rows without a join. Texts are
shuffled only where a bounded bitmap of keys has their key.

A null or empty text has no shingles and links with nothing: its component is its own id. With fewer than ``k`` words
the whole sequence is one shingle. Repeated rows are documents like others. Null ids take part, but are no smallest
id unless there is no other. An empty table gives an empty result. Other columns are not read.

Shingles are 64-bit hashes; a wrong size needs two equal hashes in one document, which 20,000 shingles bring about
with a chance of 10^-11. Sets are known by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.graphs import components
from pairloom.llm.tables import free_name, having, key_marks, named, stage
from pairloom.llm.words import blocks, chained, hashed_words, mix

K = 3
PERCENT = 90
COUNTERS = 1 << 22
FAN_IN = 16  # count tables added up by one task
BLOCK = 128  # members of a signature in one block of a tile
BLOCK_TOKENS = 1 << 18  # tokens of sets in one block of a tile
SMALL = 5  # sets of fewer than 2^SMALL tokens use single tokens only
SALTS = mix(np.arange(1, 65, dtype=np.uint64))  # of the size ranges
SEEN = 1 << 16  # sets that a task remembers to have signed, or to have connected


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of every text of a block."""
    words, cuts = hashed_words(data, bounds, lower=True)
    runs = {j: chained(words, j) for j in range(1, k + 1)}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = b - a
        if n >= k:
            yield np.unique(runs[k][a : b - k + 1])
        else:
            yield runs[n][a : a + 1] if n else words[:0]


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a set."""
    with np.errstate(over="ignore"):
        one = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
        two = mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def bitmap(tokens: np.ndarray, percent: int) -> bytes:
    """Parities of the tokens in hash cells, a power of two: at least 128, and four for each token in which linked sets of
    this size may differ, as unlike sets differ in about half of the cells."""
    cells = 1 << max(7, (8 * len(tokens) * (100 - percent) // (100 + percent)).bit_length())
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as it would be with only ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def can_link(n: np.ndarray, m: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m tokens with at least ``differing`` tokens in only one of them can link."""
    return differing * (100 + percent) <= (n + m) * (100 - percent)


def most_missing(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked partner may lack."""
    return n - -(-n * percent // 100)


def token_counts(df: DataFrame, text: str, k: int) -> np.ndarray:
    """In how many documents the tokens of each of COUNTERS hash cells occur, over all documents. Tasks add up their
    tables in a tree of FAN_IN, so that the driver gets a few tables of fixed size."""

    def table(total: np.ndarray) -> pa.RecordBatch:
        raw = pa.compress(total.tobytes(), codec="zstd", asbytes=True)  # most counts of one task are small
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, data, bounds in blocks(batch.column(0)):
                tokens = np.concatenate(list(shingle_sets(data, bounds, k)))
                np.add.at(total, (tokens & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield table(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += read(raw.as_buffer())
        yield table(total)

    def read(raw) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, COUNTERS * 8, codec="zstd"), np.int64)

    tables = df.select(text).mapInArrow(count, "counts binary")
    left = df.rdd.getNumPartitions()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        tables = tables.repartition(left).mapInArrow(add, "counts binary")
    total = np.zeros(COUNTERS, np.int64)
    for row in tables.toLocalIterator():
        total += read(row["counts"])
    return total


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set, given its tokens in the common order and which of them are frequent, and for each a bit for
    every size range it is meant for."""
    n = len(tokens)
    need = most_missing(n, percent) + 1
    low, high = -(-n * percent // 100), n * 100 // percent
    sizes = range(low.bit_length() - 1, high.bit_length())
    out, meant = [], []

    def add(found: np.ndarray, ranges: Iterable[int]) -> None:
        out.append(found)
        meant.append(np.full(len(found), sum(1 << size for size in ranges), np.int64))

    rare = tokens[~frequent]
    add(mix(tokens[:need]), (size for size in sizes if size < SMALL))
    add(mix(rare[:need]), (size for size in sizes if size >= SMALL))
    for size in sizes:
        if size < SMALL or len(rare) >= need:
            continue
        salt = np.uint64((size + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
        often = tokens[frequent]
        subclass = (often >> np.uint64(21)) % np.uint64((1 << size) // 8)
        _, first = np.unique(subclass, return_index=True)
        fresh = np.zeros(len(often), np.int64)
        fresh[first] = 1
        safe = np.arange(1, len(often) + 1) - np.cumsum(fresh)
        taken = int(np.searchsorted(safe, need - len(rare))) + 1
        often, subclass = often[:taken], subclass[:taken]
        order = np.argsort(subclass, kind="stable")
        often, subclass = often[order], subclass[order]
        for step in range(1, len(often)):  # pairs of one subclass stand next to each other
            same = subclass[step:] == subclass[:-step]
            if not same.any():
                break
            add(mix(often[:-step][same] * np.uint64(0x9FB21C651E98DF25) + mix(often[step:][same]) + salt), [size])
    found, meant = np.concatenate(out), np.concatenate(meant)
    return found[meant > 0], meant[meant > 0]


def classes_of(df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(key, n, one, two, bits) of every row, staged: size, digest and bitmap of its set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (len(s), *(digest(s) if len(s) else (None, None)), bitmap(s, percent))
                for _, data, bounds in blocks(batch.column(1))
                for s in shingle_sets(data, bounds, k)
            ]
            if rows:
                *numbers, bits = zip(*rows, strict=True)
                columns = [*(pa.array(c, pa.int64()) for c in numbers), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n", "one", "two", "bits"])

    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = own.select("key").schema.add("n", "long").add("one", "long").add("two", "long").add("bits", "binary")
    return stage(own.mapInArrow(describe, schema), "join-classes")


def signed(df: DataFrame, text: str, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(signature, meant, one) rows: signatures and their size ranges; those of equal sets may repeat."""
    bar = max(64, 2 * int(counts.mean()))
    frequent_cells = np.packbits(counts > bar)
    ranks = np.minimum(counts - counts.min(), (1 << 16) - 1).astype(np.uint16)  # an order, with many highest or not

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(frequent_cells).astype(bool)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, data, bounds in blocks(batch.column(0)):
                found, ones = [], []
                for tokens in shingle_sets(data, bounds, k):
                    if len(tokens) and (own := digest(tokens)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(own)
                        cells = (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)
                        order = np.argsort(ranks[cells], kind="stable")  # equal ranks by token
                        found.append(signatures(tokens[order], frequent[cells[order]], percent))
                        ones.append(own[0])
                if found:
                    times = [len(s) for s, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([s for s, _ in found]).view(np.int64)),
                            pa.array(np.concatenate([meant for _, meant in found])),
                            pa.array(np.repeat(np.array(ones, np.int64), times)),
                        ],
                        ["signature", "meant", "one"],
                    )

    return df.select(text).mapInArrow(sign, "signature bigint, meant bigint, one bigint")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets link."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, by class digest) whose sets link, as class numbers (a, b)."""
    left = sets.select(F.col("one").alias("b"), F.col("node").alias("node_b"), F.col("tokens").alias("tokens_b"))
    right = sets.select(F.col("one").alias("a"), F.col("node").alias("node_a"), F.col("tokens").alias("tokens_a"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(similar(x, y, percent))
            linked = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([linked.column(0), linked.column(1)], ["a", "b"])

    # the narrow rows meet the sets of the leaders first, so that a leader's many rows are small when they are dealt
    rows = pairs.join(left, "b").join(right, "a").where("node_a <> node_b")
    return rows.select("node_a", "node_b", "tokens_a", "tokens_b").mapInArrow(check, "a bigint, b bigint")


def numbered(classes: DataFrame) -> DataFrame:
    """(node, one, two, n, bits, least, rows) of every class, staged: its number, set, smallest key and rows."""
    least = classes.where("n > 0").groupBy("one", "two", "n", "bits")
    least = least.agg(F.min("key").alias("least"), F.count("*").alias("rows"))
    return stage(least.withColumn("node", F.monotonically_increasing_id()), "join-numbers")


def candidate_sets(df: DataFrame, numbers: DataFrame, pairs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(node, one, tokens) of the classes in pairs, from one document each, staged."""
    wanted = pairs.select(F.col("a").alias("one")).unionByName(pairs.select(F.col("b").alias("one"))).distinct()
    chosen = stage(numbers.join(wanted, "one", "left_semi").select("least", "one", "two", "node"), "join-wanted")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in blocks(batch.column(0)):
                asked = batch.slice(first, len(bounds) - 1)
                sets = list(shingle_sets(data, bounds, k))
                found = [digest(tokens) for tokens in sets]
                classes = zip(asked.column(1).to_pylist(), asked.column(2).to_pylist(), strict=True)
                same = [x == y for x, y in zip(found, classes, strict=True)]  # a key may repeat with other texts
                raws = pa.array([tokens.tobytes() for tokens in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [asked.column(3), asked.column(1), raws], ["node", "one", "tokens"]
                ).filter(pa.array(same, pa.bool_()))

    own = having(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", key_marks(chosen, "least"))
    texts = own.join(chosen, own["key"].eqNullSafe(chosen["least"])).select("text", "one", "two", "node")
    sets = texts.mapInArrow(sets_of, "node bigint, one bigint, tokens binary")
    return stage(sets.dropDuplicates(["node"]), "join-sets")


def near(a: str, b: str, percent: int):
    """Whether sets of these sizes can link."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def sieved(pairs: DataFrame, numbers: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""
    side = lambda c: numbers.select(
        F.col("one").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")
    )

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differing = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                size = min(len(x), len(y))
                differing.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            keep = can_link(n, m, np.array(differing, np.int64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(side("b"), "b").join(side("a"), "a").where(near("n_a", "n_b", percent))
    return rows.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(sieve, "a bigint, b bigint")


def shared(rows: DataFrame, parts: int) -> DataFrame:
    """(signature, one, low, high) of the members of signatures that several sets of one size range have, with the
    smallest and the largest member. Sorted rows pass by, and only those of one signature, three numbers each, wait."""

    def members(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        signature, meant, one = np.concatenate(held, axis=1)
        salted, ones = [], []
        for size in range(int(np.bitwise_or.reduce(meant)).bit_length()):
            inside = (meant >> size & 1).astype(bool)
            salted.append(mix(signature[inside].view(np.uint64) + SALTS[size]).view(np.int64))
            ones.append(one[inside])
        signature, one = np.concatenate(salted), np.concatenate(ones)
        order = np.lexsort((one, signature))
        signature, one = signature[order], one[order]
        new = np.ones(len(one), bool)
        new[1:] = (signature[1:] != signature[:-1]) | (one[1:] != one[:-1])
        signature, one = signature[new], one[new]
        start = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
        times = np.diff(np.append(start, len(one)))
        several = np.repeat(times > 1, times)
        columns = signature, one, np.repeat(one[start], times), np.repeat(one[start + times - 1], times)
        found = [pa.array(c[several]) for c in columns]
        yield from pa.table(found, ["signature", "one", "low", "high"]).to_batches(1 << 16)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy() for c in range(3)])
            last = int(np.searchsorted(new[0], new[0, -1]))  # the last signature may go on
            if held and (last or held[-1][0, -1] != new[0, 0]):
                yield from members([*held, new[:, :last]])
                held = []
            elif last:
                yield from members([new[:, :last]])
            held.append(new[:, last:])
        if held:
            yield from members(held)

    rows = rows.repartition(parts, "signature").sortWithinPartitions("signature")
    return rows.mapInArrow(pick, "signature bigint, one bigint, low bigint, high bigint")


class Forest:
    """Numbers known to be connected, as far as remembered."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def roots(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.above) > SEEN:
            self.above.clear()
        return np.array([self.root(x) for x in numbers.tolist()], np.int64)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)


def dealt(inner: DataFrame, groups: DataFrame) -> DataFrame:
    """(i, j, members) tiles of the members of groups (signature, weight, anchor). A group of large weight is dealt out
    as tiles of two blocks, so no tile holds more than two blocks of it; members are gathered in blocks first, which are
    then dealt as one row each. Tiles of the same blocks of groups with the same anchor meet in one task."""
    blocks_of = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("weight"), F.lit(1.0))))).cast("long")
    own = F.pmod(F.xxhash64("one", F.lit("block")), blocks_of)
    member = F.struct("own", *(c for c in inner.columns if c != "signature"))
    rows = inner.join(groups, "signature").withColumn("own", own)
    block = rows.groupBy("signature", "anchor", "weight", "own").agg(F.collect_list(member).alias("block"))
    block = block.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks_of - 1)))
    low, high = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    block = block.select("signature", "anchor", low, high, "block")
    tiles = block.repartition("anchor", "i", "j").groupBy("anchor", "i", "j", "signature").agg(
        F.flatten(F.collect_list("block")).alias("members")
    )
    return tiles.where(F.size("members") > 1).select("i", "j", "members")


def fitting(batch: pa.RecordBatch, percent: int) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each tile its members, the places of those in either block, and which of these are in different components
    and not ruled out by sizes and bitmaps."""
    for i, j, tile in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        members = tile.values
        own, n, component = (members.field(c).to_numpy() for c in ("own", "n", "component"))
        x = np.flatnonzero(own == i)
        y = np.flatnonzero(own == j)
        if not len(x) or not len(y) or component.min() == component.max():
            continue
        raws = members.field("bits").to_pylist()
        size = min(map(len, raws))
        bits = np.stack([folded(raw, size) for raw in raws])
        differing = np.stack([np.bitwise_count(bits[y] ^ bits[k]).sum(axis=1, dtype=np.int64) for k in x])
        fits = can_link(n[x][:, None], n[y][None, :], differing, percent)
        fits &= 100 * np.minimum.outer(n[x], n[y]) >= percent * np.maximum.outer(n[x], n[y])
        fits &= component[x][:, None] != component[y][None, :]
        if i == j:
            fits = np.triu(fits, 1)
        if fits.any():
            yield members, x, y, fits


def spanning(
    label: np.ndarray, x: np.ndarray, y: np.ndarray, fits: np.ndarray, links: Callable[[int, int], bool]
) -> Iterator[tuple[int, int]]:
    """Fitting pairs that link, without those whose ends earlier ones or equal labels connect."""
    for k, row in zip(x.tolist(), fits, strict=True):
        for m in y[row & (label[y] != label[k])].tolist():
            if label[k] != label[m] and links(k, m):
                yield k, m
                label[label == label[m]] = label[k]


def candidates(tiles: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the pairs in tiles that may link: whoever is in such a pair is in it, and connected."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for members, x, y, fits in fitting(batch, percent):
                one = members.field("one").to_numpy()
                for k, m in spanning(known.roots(one), x, y, fits, lambda k, m: True):
                    known.join(int(one[k]), int(one[m]))
                    found.append((int(one[k]), int(one[m])))
            yield pairs_batch(found)

    return tiles.mapInArrow(compare, "a bigint, b bigint").distinct()


def links_in(tiles: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b), by class numbers, of the links between components in tiles of members with tokens."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for members, x, y, fits in fitting(batch, percent):
                node, component = (members.field(c).to_numpy() for c in ("node", "component"))
                sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in members.field("tokens")]
                for k, m in spanning(known.roots(component), x, y, fits, lambda k, m: similar(sets[k], sets[m], percent)):
                    known.join(int(component[k]), int(component[m]))
                    found.append((int(node[k]), int(node[m])))
            yield pairs_batch(found)

    return tiles.mapInArrow(compare, "a bigint, b bigint")


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def linked_classes(df: DataFrame, numbers: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(node, component) of the classes that link with another."""
    rows = signed(df, text, k, percent, token_counts(df, text, k))
    members = stage(shared(rows, max(1, 2 * df.rdd.getNumPartitions())), "join-members")
    ends = F.explode(F.array("low", "high")).alias("b")
    first = members.select(F.col("one").alias("a"), ends).where("a <> b").distinct()
    first = stage(sieved(first, numbers, percent), "join-pairs")
    links = stage(verified(first, candidate_sets(df, numbers, first, key, text, k), percent), "join-links")
    labels = components(links)
    # what the ends did not bring together: members of one signature in different components
    known = numbers.join(labels, "node", "left")
    known = known.select("one", "node", "n", "bits", F.coalesce("component", "node").alias("component"))
    inner = members.where("one <> low and one <> high").select("signature", "one")
    inner = stage(inner.join(known.drop("node"), "one"), "join-inner")
    mixed = inner.groupBy("signature").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        (F.count("*") / BLOCK).alias("weight"),
        F.min("one").alias("anchor"),
    )
    mixed = stage(mixed.where("x <> y").select("signature", "weight", "anchor"), "join-mixed")
    rest = stage(candidates(dealt(inner, mixed), percent), "join-rest")
    if rest.limit(1).count():
        clusters = components(rest).select(F.col("node").alias("one"), F.col("component").alias("signature"))
        close = stage(known.join(clusters, "one"), "join-close")
        weight = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS).alias("weight")
        groups = close.groupBy("signature").agg(weight).withColumn("anchor", F.col("signature"))
        sets = candidate_sets(df, numbers, rest, key, text, k).select("node", "tokens")
        more = stage(links_in(dealt(close.join(sets, "node"), groups), percent), "join-links")
        if more.limit(1).count():
            labels = components(links.unionByName(more))
    return labels


def components_of_classes(
    df: DataFrame, classes: DataFrame, key: str, text: str, k: int, percent: int
) -> DataFrame:
    """(one, two, component_id) of the classes with several rows or with links, staged."""
    numbers = numbered(classes)
    labels = linked_classes(df, numbers, key, text, k, percent)
    joined = stage(numbers.join(labels, "node", "left").where("rows > 1 or component is not null"), "join-groups")
    reached = joined.where("component is not null").groupBy("component").agg(F.min("least").alias("reached"))
    found = joined.join(reached, "component", "left")
    return stage(found.select("one", "two", F.coalesce("reached", "least").alias("component_id")), "join-found")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    classes = classes_of(df, key, text, k, percent)
    found = components_of_classes(df, classes, key, text, k, percent)
    return classes.join(found, ["one", "two"], "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, that stand for their group: those whose id is the smallest of the group; of
    rows that repeat it with an equal set, one stays. Rows without shingles are no copies and all stay."""
    classes = classes_of(df, key, text, k, percent)
    found = components_of_classes(df, classes, key, text, k, percent)
    one, two, group = (free_name(df, name) for name in ("digest_one", "digest_two", "group_id"))

    @F.arrow_udf("one bigint, two bigint")
    def digests(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sets = [s for _, data, bounds in blocks(column) for s in shingle_sets(data, bounds, k)]
            pairs = [digest(s) if len(s) else (None, None) for s in sets]
            yield pa.StructArray.from_arrays(
                [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["one", "two"]
            )

    # all rows of a key that has no row in a group stay as they are; only the others meet the groups
    marks = key_marks(classes.join(found, ["one", "two"], "left_semi"), "key")
    alone = having(df, key, marks, False)
    found = found.select(F.col("one").alias(one), F.col("two").alias(two), F.col("component_id").alias(group))
    rows = having(df, key, marks).withColumn(one, digests(F.col(text)))
    rows = rows.withColumn(two, F.col(f"{one}.two")).withColumn(one, F.col(f"{one}.one")).join(found, [one, two], "left")
    rows = rows.where(F.col(one).isNull() | F.col(group).isNull() | F.col(group).eqNullSafe(F.col(key)))
    if classes.where("n > 0").groupBy("key", "one", "two").count().where("count > 1").limit(1).count():
        whole = rows.where(F.col(one).isNotNull()).dropDuplicates([key, one, two])
        rows = whole.unionByName(rows.where(F.col(one).isNull()))
    return named(rows, df.columns).union(alone)


ORACLE = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM tokens a JOIN tokens b
  ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 90 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(doc_id, c) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN edges e ON e.a = r.doc_id AND r.c < e.b)
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN reach USING (doc_id)
"""
