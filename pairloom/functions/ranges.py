"""Arrow functions over the lines of byte ranges: what each range does to the state of quotes, and its records.

A batch may hold the end of one range and the start of the next, and a range may span batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "﻿"  # byte order mark


def _runs(batch: pa.RecordBatch, *keys: str) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows with equal keys."""
    if not batch.num_rows:
        return
    starts = np.zeros(batch.num_rows, bool)
    starts[0] = True
    for key in keys:
        column = batch.column(key)
        starts[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    cuts = np.append(np.flatnonzero(starts), batch.num_rows)
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(first, last - first)


def states(then_out: np.ndarray, then_in: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line starts inside quotes, and whether one after the last would (one element more). A line with one
    outcome fixes the state; any other keeps or flips it, so the parity of flips since the last fixed line decides."""
    index = np.arange(len(then_out))
    last = np.maximum.accumulate(np.where(then_out == then_in, index, -1))
    flips = np.concatenate([[0], np.cumsum(then_out & ~then_in)])
    base = np.where(last >= 0, then_out[last], inside)
    return np.concatenate([[inside], base ^ ((flips[1:] - flips[last + 1]) % 2 == 1)])


def _flags(run: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [run.column(name).to_numpy(zero_copy_only=False) for name in names]


def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range, with the state at its end and the records it starts from either state at its start."""
    now: dict = {}
    for batch in batches:
        for run in _runs(batch, "path", "block"):
            key = {name: run.column(name)[0].as_py() for name in ("path", "block")}
            if {name: now.get(name) for name in key} != key:
                if now:
                    yield pa.RecordBatch.from_pylist([now], schema=REPORT)
                now = key | {"returns": run.column("returns")[0].as_py()}
                now |= {"end_out": False, "records_out": 0, "end_in": True, "records_in": 0}
            then_out, then_in, blank = _flags(run, "then_out", "then_in", "blank")
            for start in ("out", "in"):
                state = states(then_out, then_in, now[f"end_{start}"])
                now[f"end_{start}"] = bool(state[-1])
                now[f"records_{start}"] += int((~state[:-1] & ~blank).sum())
    if now:
        yield pa.RecordBatch.from_pylist([now], schema=REPORT)


REPORT = pa.schema(
    {"path": pa.string(), "block": pa.int64(), "returns": pa.bool_()}
    | {"end_out": pa.bool_(), "records_out": pa.int64(), "end_in": pa.bool_(), "records_in": pa.int64()}
)
REPORT_DDL = (
    "path string, block bigint, returns boolean, end_out boolean, records_out bigint, end_in boolean, records_in bigint"
)
def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, record, piece, cut, text): the texts of records, whole or cut where a range or a batch ends. Headers
    are left out."""
    now: tuple | None = None
    inside, record = False, 0
    for at, batch in enumerate(batches):
        for run in _runs(batch, "path", "block"):
            file, block, first, header, crlf = (
                run.column(c)[0].as_py() for c in ("file", "block", "first", "header", "crlf")
            )
            values = run.column("value")
            if (file, block) != now:
                now, inside, record = (file, block), run.column("inside")[0].as_py(), first - 1
                if block == 0 and values[0].as_py().startswith(MARK):
                    values = pa.concat_arrays([pa.array([values[0].as_py()[1:]], values.type), values.slice(1)])
            if crlf:
                values = pc.replace_substring_regex(values, r"\r$", "")
            then_out, then_in, blank = _flags(run, "then_out", "then_in", "blank")
            state = states(then_out, then_in, inside)
            begins = ~state[:-1] & ~blank
            numbers = record + np.cumsum(begins)
            inside, record = bool(state[-1]), int(numbers[-1])
            kept = np.flatnonzero((begins | state[:-1]) & (numbers > header))
            if not len(kept):
                continue
            starts = np.flatnonzero(np.diff(numbers[kept], prepend=numbers[kept[0]] - 1))
            ends = pa.array(np.append(starts, len(kept)), pa.int32())
            lines = pa.ListArray.from_arrays(ends, values.take(pa.array(kept)).cast(pa.string()))
            cut = np.zeros(len(starts), bool)
            cut[0] = not begins[kept[0]]  # goes on from an earlier piece
            cut[-1] |= inside  # goes on in a later one
            constants = [pa.array(np.full(len(starts), x, np.int64)) for x in (file, block, at)]
            each = pa.array(numbers[kept][starts].astype(np.int64))
            arrays = [*constants[:2], each, constants[2], pa.array(cut), pc.binary_join(lines, "\n")]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "record", "piece", "cut", "text"])
