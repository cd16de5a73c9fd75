"""Multiset n-gram overlap of sequence pairs, counted a whole Arrow batch at a time.

Spark prepares the sequences (strings or token arrays) and sums the counts; this module only does
the one step Spark has no expression for: how many n-grams two sequences share, with repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

CHUNK = 1 << 16  # symbols of pairs coded and worked on at once, and one pair
PAIRS = 1 << 16  # candidate pairs scored at once
BUFFER = 8 << 20  # bytes of tiles held at once, or one tile


def symbols(*arrays: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Integer-code strings (by character) or lists of strings (by element).

    Gives (codes, row offsets) for each array; equal symbols get equal codes across all arrays.
    """
    flat, offsets = [], []
    for array in arrays:
        if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
            array = array.fill_null("")
            lengths = pc.utf8_length(array)
            joined = "".join(array.to_pylist())
            flat.append(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        else:
            lengths = pc.list_value_length(array).fill_null(0)
            flat.append(array.flatten())
        offsets.append(np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))]).astype(np.int64))
    if isinstance(flat[0], np.ndarray):
        everything = np.concatenate(flat)
        seen = np.zeros(int(everything.max(initial=0)) + 1, dtype=bool)
        seen[everything] = True
        codes = (np.cumsum(seen) - 1)[everything]
    else:
        chunks = [a.chunks if isinstance(a, pa.ChunkedArray) else [a] for a in flat]
        encoded = pa.chunked_array([c for group in chunks for c in group], type=flat[0].type)
        codes = encoded.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum([o[-1] for o in offsets])
    return [(part.astype(np.int64), o) for part, o in zip(np.split(codes, ends[:-1]), offsets)]


def take(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences ``rows`` (repeats allowed) as (codes, lengths)."""
    lengths = offsets[rows + 1] - offsets[rows]
    shift = np.repeat(offsets[rows] - np.cumsum(lengths) + lengths, lengths)
    return codes[shift + np.arange(len(shift))], lengths


def shared_grams(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, orders: int):
    """Shared n-gram counts of aligned sequence pairs, one column per order 1..orders.

    ``left``/``right`` hold the codes of all sequences end to end, ``n_left``/``n_right`` their lengths.
    A position's key is its pair, then its symbols, then its side. One sort puts the n-grams of every order in runs, as
    an n-gram is a prefix of the key. Symbols behind the end of a sequence differ by side, so such runs share nothing.
    What a run does not share is the difference of its sides. Keys of more than 63 bits are made in steps, the
    next one starting from the rank of what came before.
    """
    pairs, out = len(n_left), np.zeros((len(n_left), orders), dtype=np.int64)
    lengths = np.concatenate([n_left, n_right])
    owner = np.repeat(np.arange(2 * pairs), lengths)
    if not len(owner):
        return out
    at = np.arange(len(owner)) + owner * (orders - 1)
    symbol = np.ones(len(owner) + 2 * pairs * (orders - 1), np.int64)
    symbol[: len(left) + pairs * (orders - 1)] = 0
    codes = np.concatenate([left, right])
    if codes.max() > len(codes):  # a key has room for as many symbols as there are places
        codes = np.unique(codes, return_inverse=True)[1]
    symbol[at] = codes + 2
    bits = int(symbol.max()).bit_length()
    side = (owner >= pairs).astype(np.int64)
    prefix = owner - side * pairs
    starts = np.concatenate([[0], np.cumsum(n_left + n_right)])  # of pairs, in every order of keys
    done = 0
    while done < orders:
        width = min((62 - int(prefix.max()).bit_length()) // bits, orders - done)
        packed = symbol[done : len(symbol) - orders + done + 1].copy()  # over all places at first, without lookups
        for k in range(done + 1, done + width):
            packed <<= bits
            packed |= symbol[k : len(symbol) - orders + k + 1]
        key = (prefix << (bits * width + 1)) | (packed.take(at) << 1) | side
        if done + width < orders:
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
        else:
            key.sort()
        balance = np.zeros(len(key) + 1, np.int32)
        np.cumsum(1 - 2 * (key & 1).astype(np.int32), out=balance[1:])
        change = key[1:] ^ key[:-1]
        runs = np.flatnonzero(change > 1)
        change = change.take(runs)
        if done + width < orders:
            rank = np.zeros(len(key), np.int64)
            rank[runs + 1] = 1
            prefix = np.empty_like(rank)
            prefix[by_key] = np.cumsum(rank)
        for k in range(width - 1, -1, -1):
            if k < width - 1:
                shorter = np.flatnonzero(change >= 1 << (1 + bits * (width - 1 - k)))
                runs, change = runs.take(shorter), change.take(shorter)
            bounds = np.concatenate([[0], runs + 1, [len(key)]])
            apart = np.concatenate([[0], np.cumsum(np.abs(np.diff(balance.take(bounds))))])
            out[:, done + k] = (np.diff(starts) - np.diff(apart[np.searchsorted(bounds, starts)])) // 2
        done += width
    return out


def pair_overlap(left, right, rows_left: np.ndarray, rows_right: np.ndarray, orders: int):
    """``shared_grams`` for chosen row pairs of two coded columns, in bounded chunks."""
    sizes = (left[1][rows_left + 1] - left[1][rows_left]) + (right[1][rows_right + 1] - right[1][rows_right])
    chunk = np.cumsum(sizes) // CHUNK
    bounds = np.flatnonzero(np.diff(chunk)) + 1
    parts = [
        shared_grams(*take(*left, a), *take(*right, b), orders)
        for a, b in zip(np.split(rows_left, bounds), np.split(rows_right, bounds))
    ]
    return np.concatenate(parts)


def gram_totals(offsets: np.ndarray, orders: int) -> np.ndarray:
    return np.maximum(np.diff(offsets)[:, None] - np.arange(orders)[None, :], 0)


def as_list_array(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))


def n_symbols(array: pa.Array) -> np.ndarray:
    """Characters of strings, or elements of lists, per row."""
    is_text = pa.types.is_string(array.type) or pa.types.is_large_string(array.type)
    count = pc.utf8_length(array) if is_text else pc.list_value_length(array)
    return count.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def batch_overlap(left: pa.Array, right: pa.Array, orders: int) -> np.ndarray:
    """Shared n-gram counts of the rows of a batch, of which CHUNK symbols or one row are coded at once. A batch of
    10,000 documents holds a hundred times that, and coded symbols take many times the room of text."""
    part = np.cumsum(n_symbols(left) + n_symbols(right)) // CHUNK
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1), len(left)]
    parts = [np.zeros((0, orders), np.int64)]
    for start, end in zip(bounds[:-1], bounds[1:]):
        (a, ends_a), (b, ends_b) = symbols(left.slice(start, end - start), right.slice(start, end - start))
        parts.append(shared_grams(a, np.diff(ends_a), b, np.diff(ends_b), orders))
    return np.concatenate(parts)


def overlap_udf(orders: int):
    """Arrow function (left, right) -> shared n-gram counts for orders 1..orders."""

    @F.arrow_udf(ArrayType(LongType()))
    def shared(left: pa.Array, right: pa.Array) -> pa.Array:
        return as_list_array(batch_overlap(left, right, orders))

    return shared


def overlap(left: Column, right: Column, orders: int) -> Column:
    """How many n-grams two strings (or token arrays) share, as an array over orders 1..orders."""
    return overlap_udf(orders)(left, right)


def pair_list(first: np.ndarray, second: np.ndarray | None):
    """All unordered pairs of one block, or all pairs between two blocks."""
    if second is None:
        a, b = np.triu_indices(len(first), k=1)
        return first[a], first[b]
    return np.repeat(first, len(second)), np.tile(second, len(first))


def chrf_score(shared, n_hyp, n_ref, beta: float = 2.0):
    """Sentence chrF from counts per order (columns)."""
    n_hyp = np.where(n_ref > 0, n_hyp, 0)
    used = (n_hyp > 0) & (n_ref > 0)
    effective = np.maximum(used.sum(axis=1), 1)
    precision = np.where(used, shared / np.maximum(n_hyp, 1), 0.0).sum(axis=1) / effective
    recall = np.where(used, shared / np.maximum(n_ref, 1), 0.0).sum(axis=1) / effective
    below = beta**2 * precision + recall
    return np.where(below > 0, 100 * (1 + beta**2) * precision * recall / np.where(below > 0, below, 1.0), 0.0)


def bleu_score(shared, n_hyp, n_ref):
    """Sentence BLEU with exponential smoothing from counts per order (columns)."""
    smooth = np.cumsum(shared == 0, axis=1)
    precision = np.where(shared > 0, shared, 0.5**smooth) * 100.0 / np.maximum(n_hyp, 1)
    defined = (shared.sum(axis=1) > 0) & (n_hyp > 0).all(axis=1)
    hyp_len, ref_len = n_hyp[:, 0], n_ref[:, 0]
    brevity = np.where(hyp_len < ref_len, np.exp(1 - ref_len / np.maximum(hyp_len, 1)), 1.0)
    return np.where(defined, brevity * np.exp(np.log(precision).mean(axis=1)), 0.0)


def add_pair_scores(
    sums: dict[str, np.ndarray], coded: dict, weight: np.ndarray, left: np.ndarray, right: np.ndarray
) -> None:
    """Add both directions of every (left, right) pair to the per-member sums, scores times the partner's weight."""
    members = len(sums["partners"])
    sums["partners"] += np.bincount(left, minlength=members) + np.bincount(right, minlength=members)
    sums["weight"] += np.bincount(left, weight[right], members) + np.bincount(right, weight[left], members)
    for name, score, fields in (
        ("chrf", chrf_score, (("chars", 6), ("words", 2))),
        ("bleu", bleu_score, (("tokens", 4),)),
    ):
        shared = np.hstack([pair_overlap(coded[f], coded[f], left, right, k) for f, k in fields])
        totals = np.hstack([gram_totals(coded[f][1], k) for f, k in fields])
        sums[name] += np.bincount(left, weight[right] * score(shared, totals[left], totals[right]), members)
        sums[name] += np.bincount(right, weight[left] * score(shared, totals[right], totals[left]), members)


def tile_starts(batch: pa.RecordBatch) -> np.ndarray:
    """Rows at which a tile (id, i, j) starts; rows come in the order of tiles."""
    starts = np.zeros(batch.num_rows, bool)
    starts[:1] = True
    for name in ("id", "i", "j"):
        column = batch.column(name)
        starts[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(starts)


def tile_scores(members: pa.RecordBatch) -> pa.RecordBatch:
    """Per candidate of whole tiles: its partners in the tile, their weight, and the weighted sums of sentence scores.

    ``second`` marks a tile's second block. Pairs are index arrays, scored as soon as enough of them have gathered.
    """
    starts = tile_starts(members)
    offsets = np.append(starts, members.num_rows)
    second = members.column("second").to_numpy(zero_copy_only=False)
    weight = members.column("weight").to_numpy(zero_copy_only=False)
    one_block = pc.equal(members.column("i"), members.column("j")).to_numpy(zero_copy_only=False)
    coded = {f: symbols(members.column(f))[0] for f in ("chars", "words", "tokens")}
    sums = {"partners": np.zeros(members.num_rows, np.int64)}
    sums |= {name: np.zeros(members.num_rows) for name in ("weight", "chrf", "bleu")}
    waiting, n_waiting = [], 0
    for t, start in enumerate(starts):
        inside = np.arange(start, offsets[t + 1])
        if one_block[start]:
            waiting.append(pair_list(inside, None))
        else:
            waiting.append(pair_list(inside[~second[inside]], inside[second[inside]]))
        n_waiting += len(waiting[-1][0])
        if n_waiting and (n_waiting >= PAIRS or t == len(starts) - 1):
            add_pair_scores(sums, coded, weight, *map(np.concatenate, zip(*waiting)))
            waiting, n_waiting = [], 0
    kept = ["id", "pos", "key", "text"]
    arrays = [members.column(name) for name in kept] + [pa.array(column) for column in sums.values()]
    return pa.RecordBatch.from_arrays(arrays, [*kept, *sums])


def numbered_grams(codes: np.ndarray, lengths: np.ndarray, tiles: np.ndarray, orders: int):
    """For each order, the member and a number of every n-gram of coded sequences end to end; those of each tile count apart. The first, second and so on
    place of an n-gram in a member count apart, so what two members share is the numbers both have."""
    seq, last = np.repeat(np.arange(len(lengths)), lengths), codes
    base = int(codes.max(initial=0)) + 1
    gram, bound = np.repeat(tiles, lengths), int(tiles.max(initial=0)) + 1
    for order in range(1, orders + 1):
        if order > 1:
            inside = seq[:-1] == seq[1:]
            gram, seq, last = gram[:-1][inside], seq[:-1][inside], last[1:][inside]
        if bound * base >= 1 << 61:
            gram = np.unique(gram, return_inverse=True)[1]
            bound = int(gram.max(initial=0)) + 1
        gram = gram * base + last
        bound *= base
        by_member = np.lexsort((gram, seq))
        member, same = seq[by_member], gram[by_member]
        new = np.ones(len(same), bool)
        new[1:] = (member[1:] != member[:-1]) | (same[1:] != same[:-1])
        at = np.arange(len(same))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        number = np.unique(same, return_inverse=True)[1] * (int(place.max(initial=0)) + 1) + place
        yield member, np.unique(number, return_inverse=True)[1]


def shared_sums(
    coded, rows: np.ndarray, tiles: np.ndarray, hyp: np.ndarray, ref: np.ndarray, weight: np.ndarray, orders: int
):
    """For members ``rows`` of tiles numbered ``tiles``, of which ``hyp`` are compared with ``ref`` (masks), and for each order: the
    n-grams shared with each partner times its weight, added up over partners; and the same over the partner's total.
    Time goes with the n-grams, not with pairs. A member that is in both masks is no partner of itself."""
    codes, lengths = take(*coded, rows)
    shared, of_ref = np.zeros((len(rows), orders)), np.zeros((len(rows), orders))
    for k, (member, number) in enumerate(numbered_grams(codes, lengths, tiles, orders)):
        totals = np.maximum(lengths - k, 1)
        partner, asked = ref[member], hyp[member]
        size = int(number.max(initial=-1)) + 1
        held = np.bincount(number[partner], weight[member[partner]], size)
        shares = np.bincount(number[partner], (weight / totals)[member[partner]], size)
        shared[:, k] = np.bincount(member[asked], held[number[asked]], len(rows))
        of_ref[:, k] = np.bincount(member[asked], shares[number[asked]], len(rows))
        own = (hyp & ref) * weight * (lengths > k)
        shared[:, k] -= own * np.maximum(lengths - k, 0)
        of_ref[:, k] -= own
    return shared, of_ref


BOUND_SUMS = ["partners", "weight", "precision", "recall", "b1", "b2", "b3", "b4"]


def tile_bounds(members: pa.RecordBatch) -> pa.RecordBatch:
    """Per candidate of whole tiles, sums over its partners in the tile, from counts alone: partners, their weight, at
    least the chrF precisions and recalls, and shared token n-grams of each order; and the candidate's tokens."""
    starts = tile_starts(members)
    offsets = np.append(starts, members.num_rows)
    second = members.column("second").to_numpy(zero_copy_only=False)
    weights = members.column("weight").to_numpy(zero_copy_only=False)
    one_block = pc.equal(members.column("i"), members.column("j")).to_numpy(zero_copy_only=False)
    coded = {f: symbols(members.column(f))[0] for f in ("chars", "words", "tokens")}
    sums = {name: np.zeros(members.num_rows) for name in BOUND_SUMS}
    lengths = {f: np.diff(coded[f][1]) for f in coded}
    # tiles are worked on together up to CHUNK characters, or one
    part = np.cumsum(np.add.reduceat(lengths["chars"], starts)) // CHUNK if len(starts) else np.zeros(0, int)
    firsts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(starts)]
    for first, end in zip(firsts[:-1], firsts[1:]):
        rows = np.arange(offsets[first], offsets[end])
        at = offsets[first:end] - offsets[first]
        tile = np.repeat(np.arange(end - first), np.diff(offsets[first : end + 1]))
        weight, alone, other = weights[rows], one_block[rows], second[rows]
        for hyp, ref in ((alone | ~other, alone | other), (~alone & other, ~alone & ~other)):
            if not ref.any() or not hyp.any():
                continue
            self = hyp & ref
            n_ref, of_ref_weight = np.add.reduceat(ref.astype(np.int64), at), np.add.reduceat(ref * weight, at)
            hyp = hyp & (n_ref[tile] > 0)
            sums["partners"][rows] += np.where(hyp, n_ref[tile] - self, 0)
            sums["weight"][rows] += np.where(hyp, of_ref_weight[tile] - self * weight, 0)
            precision, recall, used = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
            for field, orders in (("chars", 6), ("words", 2)):
                shared, of_ref = shared_sums(coded[field], rows, tile, hyp, ref, weight, orders)
                n = np.minimum(lengths[field][rows], orders)
                totals = np.maximum(lengths[field][rows][:, None] - np.arange(orders), 1)
                precision += (shared / totals).sum(axis=1)
                recall += of_ref.sum(axis=1)
                used += np.minimum(n, np.minimum.reduceat(np.where(ref, n, orders), at)[tile])  # no partner uses fewer
            sums["precision"][rows] += np.where(hyp, precision / np.maximum(used, 1), 0)
            sums["recall"][rows] += np.where(hyp, recall / np.maximum(used, 1), 0)
            shared, _ = shared_sums(coded["tokens"], rows, tile, hyp, ref, weight, 4)
            for k in range(4):
                sums[f"b{k + 1}"][rows] += np.where(hyp, shared[:, k], 0)
    kept = ["id", "pos", "key"]
    arrays = [members.column(name) for name in kept] + [pa.array(column) for column in sums.values()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(lengths["tokens"])], [*kept, *sums, "n_tokens"])


def add_asked_scores(
    sums: dict[str, np.ndarray], coded: dict, weight: np.ndarray, hyp: np.ndarray, ref: np.ndarray
) -> None:
    """Add the score of every ``hyp`` against its ``ref`` to the sums of ``hyp``, times the weight of ``ref``."""
    members = len(sums["partners"])
    sums["partners"] += np.bincount(hyp, minlength=members)
    sums["weight"] += np.bincount(hyp, weight[ref], members)
    for name, score, fields in (
        ("chrf", chrf_score, (("chars", 6), ("words", 2))),
        ("bleu", bleu_score, (("tokens", 4),)),
    ):
        shared = np.hstack([pair_overlap(coded[f], coded[f], hyp, ref, k) for f, k in fields])
        totals = np.hstack([gram_totals(coded[f][1], k) for f, k in fields])
        sums[name] += np.bincount(hyp, weight[ref] * score(shared, totals[hyp], totals[ref]), members)


def tile_asked(members: pa.RecordBatch) -> pa.RecordBatch:
    """``tile_scores`` for the candidates marked ``asked`` alone, as hypotheses."""
    starts = tile_starts(members)
    offsets = np.append(starts, members.num_rows)
    second, asked, weight = (members.column(c).to_numpy(zero_copy_only=False) for c in ("second", "asked", "weight"))
    one_block = pc.equal(members.column("i"), members.column("j")).to_numpy(zero_copy_only=False)
    coded = {f: symbols(members.column(f))[0] for f in ("chars", "words", "tokens")}
    sums = {name: np.zeros(members.num_rows) for name in ("partners", "weight", "chrf", "bleu")}
    waiting, n_waiting = [], 0
    for t, start in enumerate(starts):
        rows = np.arange(start, offsets[t + 1])
        for hyp in rows[asked[rows]]:
            right = rows[rows != hyp] if one_block[start] else rows[second[rows] != second[hyp]]
            waiting.append((np.full(len(right), hyp), right))
            n_waiting += len(right)
        if n_waiting >= PAIRS:
            add_asked_scores(sums, coded, weight, *map(np.concatenate, zip(*waiting)))
            waiting, n_waiting = [], 0
    if n_waiting:
        add_asked_scores(sums, coded, weight, *map(np.concatenate, zip(*waiting)))
    kept = ["id", "pos", "key"]
    arrays = [members.column(name) for name in kept] + [pa.array(column) for column in sums.values()]
    return pa.RecordBatch.from_arrays(arrays, [*kept, *sums]).filter(members.column("asked"))


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return over_tiles(batches, tile_scores)


def bound_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return over_tiles(batches, tile_bounds)


def asked_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return over_tiles(batches, tile_asked)


def over_tiles(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` over a stream of tiles, holding about BUFFER bytes of them, or one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BUFFER:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(tile_starts(whole)[-1])
            if last:
                yield work(whole.slice(0, last))
            held = [whole.slice(last)]
            size = held[0].nbytes
    rest = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from (work(batch) for batch in rest if batch.num_rows)
