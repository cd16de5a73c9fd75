r"""Vector compression by codebooks, in integers alone.

A vector becomes integers floor(SCALE * x) and is cut into PARTS parts of one width. Every part position has a codebook
of up to ENTRIES entries, which start as the parts of the vectors with the smallest ids. A round assigns each part to
its nearest entry and moves each entry to the floor of its parts' mean.

The nearest entry is found behind an integer Walsh-Hadamard transform: parts and entries are padded with zeros to a
power of two and transformed once; the sum of squared differences then is the squared distance times that power. The
coefficients are added in the order of sequency, coarse shape first. One entry, the closest by the first coefficient,
is measured in full, and an entry whose sum so far is larger than that is left out of the next coefficients. All sums
are integers, so nothing is lost and ties stay ties.

Each round is one narrow pass: a task adds up its parts by entry and only these sums are shuffled. Codebooks, whose size
is that of PARTS * ENTRIES parts, travel with the tasks. Nothing is shuffled by vector.

Vectors that are null or hold a null or a component that is no finite number are dropped. An empty vector is all zeros.
A length that PARTS does not divide is filled up with zeros. The first vector by id sets the length; vectors of another
have null code and errors, and take part in no sum. An error beyond 64 bits is null; so is the sum of such errors, and
the sum of a label goes without null errors. Repeated rows count as often as they stand. Ids that tie for the first
codebooks are told apart by their vectors, and null ids come last. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom.llm.tables import stage

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
ROWS = 4096  # vectors worked on at once: bounds memory, not results
HOT_LABELS = 1000  # labels whose sums are broadcast; any other has under a thousandth of the rows
EXACT = 1 << 62
LIMB = 32  # bits of a partial sum's limbs


def sequency_order(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix of ``width`` (a power of two) by their number of sign changes."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < width:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return np.argsort((np.diff(matrix, axis=1) != 0).sum(axis=1))


def transformed(values: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows padded with zeros to a power of two, in the order of sequency."""
    n, width = values.shape
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((n, size), values.dtype)
    out[:, :width] = values
    step = 1
    while step < size:
        pairs = out.reshape(n, -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return out[:, sequency_order(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part, the index of its nearest entry (the lowest of equals) and the squared distance."""
    a, b = transformed(parts), transformed(entries)
    rows = np.arange(len(a))
    sums = (a[:, :1] - b[:, 0]) ** 2
    guess = sums.argmin(axis=1)
    most = ((a - b[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= most[:, None])
    left = sums[row, entry]
    for k in range(1, a.shape[1]):
        left = left + (a[row, k] - b[entry, k]) ** 2
        stays = left <= most[row]
        if not stays.all():
            row, entry, left = row[stays], entry[stays], left[stays]
    starts = np.searchsorted(row, rows)  # pairs stay in the order of rows and entries
    best = np.minimum.reduceat(left, starts) if len(rows) else most
    hit = np.flatnonzero(left == best[row])
    return entry[hit[np.searchsorted(row[hit], rows)]], best // a.shape[1]


def _fits(most: int, width: int) -> bool:
    """Whether all sums over parts of components up to ``most`` stay within 64 bits."""
    size = 1 << max(0, width - 1).bit_length()
    return 4 * most * most * size * max(1, width) * PARTS < EXACT


def _whole(x: float) -> int:
    """floor(SCALE * x) of any finite number."""
    top, bottom = float(x).as_integer_ratio()
    return SCALE * top // bottom


def integers(vectors: pa.Array, length: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integer components) of the vectors of ``length``, filled up to PARTS * width: in 64 bits where that
    is exact, as Python's integers where it is not."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = np.flatnonzero(pc.list_value_length(vectors).to_numpy(zero_copy_only=False) == length)
    values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = values.reshape(len(rows), length)
    large = np.abs(values).max(axis=1, initial=0.0) >= EXACT >> 24
    scaled = np.zeros((len(rows), PARTS * width), np.int64)
    scaled[~large, :length] = np.floor(values[~large] * SCALE).astype(np.int64)
    most = np.abs(scaled).max(axis=1, initial=0)
    bound = int(most[~large].max(initial=0))
    if not _fits(bound, width):
        large |= ~np.fromiter((_fits(int(m), width) for m in most), bool, len(most))
    if (~large).any():
        yield rows[~large], scaled[~large]
    if large.any():
        exact = np.zeros((int(large.sum()), PARTS * width), object)
        exact[:, :length] = [[_whole(x) for x in row] for row in values[large]]
        yield rows[large], exact


def coded(
    vectors: pa.Array, length: int, codebooks: list[np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their components, entry of each part, squared distance of each part), a few rows at a time."""
    width = codebooks[0].shape[1]
    largest = max((int(np.abs(b).max(initial=0)) for b in codebooks), default=0)
    for rows, values in integers(vectors, length, width):
        for at in range(0, len(rows), ROWS):
            some = values[at : at + ROWS]
            kind = np.int64 if some.dtype != object and _fits(largest, width) else object
            found = [
                nearest(some[:, p * width : (p + 1) * width].astype(kind), codebooks[p].astype(kind)) for p in range(PARTS)
            ]
            yield rows[at : at + ROWS], some, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def kept(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, without nulls, infinities and NaN."""
    wrong = F.exists(F.col(f"`{vector}`"), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(f"`{vector}`").isNotNull() & ~wrong)


def moved(vectors: DataFrame, length: int, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with every entry at the floor of the mean of its parts; unused ones stay."""
    width = codebooks[0].shape[1]
    n_entries = len(codebooks[0])
    names = ["part", "entry", "position", "limb", "total", "n"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, n_entries), np.int64)
        totals = np.zeros((PARTS, n_entries, width), object)  # Python's integers: no overflow however many rows
        for batch in batches:
            for _, values, entry, _ in coded(batch.column(0), length, codebooks):
                for p in range(PARTS):
                    order = np.argsort(entry[:, p], kind="stable")
                    used, starts = np.unique(entry[order, p], return_index=True)
                    counts[p] += np.bincount(entry[:, p], minlength=n_entries)
                    added = np.add.reduceat(values[order, p * width : (p + 1) * width], starts, axis=0)
                    totals[p, used] += added.astype(object)
        rows = []
        for p, e in zip(*np.nonzero(counts), strict=True):
            rows.append((p, e, -1, 0, 0, counts[p, e]))
            for i, total in enumerate(totals[p, e]):
                limb, total = 0, int(total)
                while not -(1 << LIMB) < total < 1 << LIMB:  # the last limb carries the sign
                    rows.append((p, e, i, limb, total & ((1 << LIMB) - 1), 0))
                    limb, total = limb + 1, total >> LIMB
                rows.append((p, e, i, limb, total, 0))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in columns], names)

    schema = ", ".join(f"{name} bigint" for name in names)
    partial = vectors.select("vector").mapInArrow(sums, schema)
    summed = partial.groupBy(*names[:4]).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    counts: dict[tuple, int] = {}
    totals: dict[tuple, int] = {}
    for r in summed.collect():  # at most ENTRIES * PARTS parts
        if r["position"] < 0:
            counts[r["part"], r["entry"]] = r["n"]
        else:
            key = r["part"], r["entry"], r["position"]
            totals[key] = totals.get(key, 0) + (r["total"] << LIMB * r["limb"])
    new = [book.astype(object) for book in codebooks]
    for (p, e), n in counts.items():
        new[p][e] = [totals.get((p, e, i), 0) // n for i in range(width)]
    return [_narrow(book) for book in new]


def _narrow(book: np.ndarray) -> np.ndarray:
    """Integers in 64 bits where they fit."""
    return book.astype(np.int64) if all(abs(x) < 1 << 62 for x in book.ravel()) else book


def first_entries(vectors: DataFrame) -> tuple[int, list[np.ndarray]]:
    """The length of vectors and the codebooks made of the first vectors by id; of repeated ids, by vector."""
    order = F.col("key").isNull(), F.col("key"), F.col("vector")
    rows = [r["vector"] for r in vectors.select("key", "vector").orderBy(*order).limit(ENTRIES).collect()]
    length = len(rows[0]) if rows else 0
    width = max(1, -(-length // PARTS))
    values = np.zeros((len([r for r in rows if len(r) == length]), PARTS * width), object)
    for i, row in enumerate(r for r in rows if len(r) == length):
        values[i, :length] = [_whole(x) for x in row]
    return length, [_narrow(values[:, p * width : (p + 1) * width]) for p in range(PARTS)]


def learn(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """The length of vectors and the codebooks of (key, vector) after all rounds."""
    length, codebooks = first_entries(vectors)
    for _ in range(rounds if len(codebooks[0]) else 0):
        codebooks = moved(vectors, length, codebooks)
    return length, codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    """Of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel()).encode()).hexdigest()


def assign(vectors: DataFrame, length: int, codebooks: list[np.ndarray]) -> DataFrame:
    """(key, label, code, error) of every row of (key, label, vector)."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code: list[str | None] = [None] * len(batch)
            error: list[int | None] = [None] * len(batch)
            for rows, _, entry, distance in coded(batch.column(2), length, codebooks):
                digits = entry.astype(np.uint8).tobytes().hex()
                for k, (row, total) in enumerate(zip(rows.tolist(), distance.sum(axis=1).tolist(), strict=True)):
                    code[row] = digits[2 * PARTS * k : 2 * PARTS * (k + 1)]
                    error[row] = total if total < 1 << 63 else None
            columns = [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "code", "error"])

    schema = StructType(vectors.select("key", "label").schema.fields).add("code", "string").add("error", "long")
    return vectors.select("key", "label", "vector").mapInArrow(codes, schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the errors of a label added up. The sums of the labels with the most rows are
    broadcast; only rows of other labels, of which none has many, are shuffled."""
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")
    sums = stage(rows.groupBy("label").agg(total, F.count("*").alias("n")), "vector-code-labels")
    hot = sums.orderBy(F.desc("n"), "label").limit(HOT_LABELS).select("label", "label_error", F.lit(True).alias("hot"))
    same = rows["label"].eqNullSafe(F.col("hot_label"))
    met = rows.join(F.broadcast(hot.withColumnRenamed("label", "hot_label")), same, "left")
    rest = met.where(F.col("hot").isNull()).drop("label_error", "hot", "hot_label")
    other = sums.select(F.col("label").alias("other_label"), "label_error")
    rest = rest.join(other, F.col("label").eqNullSafe(F.col("other_label"))).drop("other_label")
    return met.where("hot").drop("hot", "hot_label").unionByName(rest)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that is kept."""
    columns = {"key": key, "label": label, "vector": vector}
    vectors = kept(df, vector).select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])
    length, codebooks = learn(vectors)
    rows = with_label_error(stage(assign(vectors, length, codebooks), "vector-codes"))
    digest = F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256")
    return rows.select(F.col("key").alias(key), "code", "error", "label_error", digest)


def decompress(codes: DataFrame, codebooks: list[np.ndarray], length: int, code: str = "code") -> DataFrame:
    """``codes`` with ``vector``, the integer components that a code stands for; null for a null code."""
    tables = [F.from_json(F.lit(str(book.tolist())), "array<array<bigint>>") for book in codebooks]
    parts = [
        F.get(tables[p], F.conv(F.substring(F.col(f"`{code}`"), 2 * p + 1, 2), 16, 10).cast("int")) for p in range(PARTS)
    ]
    return codes.withColumn("vector", F.slice(F.concat(*parts), 1, length))


def _rounds_sql() -> str:
    """CTEs a1, c1, a2 and so on: assignments to the codebooks before, and the codebooks moved."""
    distance = "list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT"
    steps = []
    for k in range(1, ROUNDS + 2):
        steps.append(f"""a{k} AS (SELECT r, p, min({distance} * {ENTRIES} + e) AS m
            FROM parts JOIN c{k - 1} USING (p) GROUP BY r, p)""")
        steps.append(f"""s{k} AS (SELECT p, m % {ENTRIES} AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n
            FROM a{k} JOIN parts USING (r, p), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL)""")
        steps.append(f"""c{k} AS (SELECT p, e, coalesce(new, y) AS y FROM c{k - 1} LEFT JOIN (
            SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS new FROM s{k} GROUP BY p, e) USING (p, e))""")
    return ",\n".join(steps[:-2])


ORACLE = f"""WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
    FROM kept, unnest(range({PARTS})) AS u(p)),
c0 AS (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= {ENTRIES}),
{_rounds_sql()},
coded AS (SELECT r, string_agg(format('{{:02x}}', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error
    FROM a{ROUNDS + 1} GROUP BY r),
digest AS (SELECT sha256(string_agg(y[i]::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
    FROM c{ROUNDS}, unnest(range(1, len(y) + 1)) AS u(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""
