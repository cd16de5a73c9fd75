"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the bytes of a text, one in each direction. From both states every position gets a probability of each
language, and the mean over the positions of the whole text is the probability of the text. The network is trained
in numpy by backpropagation through time on excerpts of labelled texts: at most SAMPLE texts of each language, and
at most EXCERPTS excerpts of EXCERPT bytes of each, chosen by hashes. Prediction reads every byte: long texts are cut
into segments that are read side by side, each with CONTEXT bytes of its text on both sides.

A text that is null or has no letter is ``und`` with score 0; so is every text when no label was learned. Repeated
rows get equal results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.tables import where_arrow
from pairloom.llm.words import blocks

UNKNOWN = "und"
SAMPLE = 500
EXCERPTS = 4
EXCERPT = 64
HIDDEN = 12
STEPS = 400
BATCH = 192
SEGMENT = 240
CONTEXT = 8
SIDE_BY_SIDE = 2048  # segments read at once
BLANK = 32


@dataclass
class Network:
    """Per direction: input table (256, 3H), recurrent weights (H, 3H), bias (H) of the candidate's recurrent part.
    Gates stand in the order update, reset, candidate. The output maps both states to languages."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    biases: list[np.ndarray]
    outputs: list[np.ndarray]
    output_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, *self.biases, *self.outputs, self.output_bias]


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)

    def drawn(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    k = len(languages)
    return Network(
        languages,
        [drawn(256, 3 * hidden) * 8 for _ in range(2)],
        [drawn(hidden, 3 * hidden) for _ in range(2)],
        [np.zeros(hidden, np.float32) for _ in range(2)],
        [drawn(hidden, k) for _ in range(2)],
        np.zeros(k, np.float32),
    )


def _gate(x: np.ndarray) -> np.ndarray:
    """A sigmoid of straight lines, in place: no exponential is taken for every byte."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return np.where((y > 0) & (y < 1), np.float32(0.25), np.float32(0))


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def run_direction(network: Network, d: int, codes: np.ndarray) -> np.ndarray:
    """Contribution of direction ``d`` to the output, (T, K, B), for byte codes (T, B). States are kept as columns, so
    that every gate is one block of memory."""
    steps, n = codes.shape
    table, bias = network.tables[d], network.biases[d][:, None]
    u, out = np.ascontiguousarray(network.recurrent[d].T), np.ascontiguousarray(network.outputs[d].T)
    hidden = u.shape[1]
    h = np.zeros((hidden, n), np.float32)
    g = np.empty((3 * hidden, n), np.float32)
    x = np.empty((3 * hidden, n), np.float32)
    rows = np.empty((n, 3 * hidden), np.float32)
    result = np.empty((steps, out.shape[0], n), np.float32)
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        np.take(table, codes[t], axis=0, out=rows, mode="clip")
        np.copyto(x, rows.T)
        np.matmul(u, h, out=g)
        gates = x[: 2 * hidden]
        gates += g[: 2 * hidden]
        _gate(gates)
        candidate = g[2 * hidden :]
        candidate += bias
        candidate *= x[hidden : 2 * hidden]
        candidate += x[2 * hidden :]
        _squash(candidate)
        h -= candidate
        h *= x[:hidden]
        h += candidate
        np.matmul(out, h, out=result[t])
    return result


def position_probabilities(network: Network, codes: np.ndarray) -> np.ndarray:
    """Probability of every language at every position, (T, K, B)."""
    logits = run_direction(network, 0, codes)
    logits += run_direction(network, 1, codes)
    logits += network.output_bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(network: Network, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over all positions, by backpropagation through time. ``weight`` (T, B) is
    0 at positions beyond a text."""
    steps, n = codes.shape
    states, kept = [], []
    logits = np.zeros((steps, n, len(network.languages)), np.float32) + network.output_bias
    for d in range(2):
        u, bias = network.recurrent[d], network.biases[d]
        hidden = u.shape[0]
        h, hs, saved = np.zeros((n, hidden), np.float32), {}, {}
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x = network.tables[d][codes[t]]
            g = h @ u
            z = _gate(x[:, :hidden] + g[:, :hidden])
            r = _gate(x[:, hidden : 2 * hidden] + g[:, hidden : 2 * hidden])
            inner = g[:, 2 * hidden :] + bias
            c = _squash(x[:, 2 * hidden :] + r * inner)
            saved[t] = (h, z, r, inner, c)
            h = c + z * (h - c)
            hs[t] = h
            logits[t] += h @ network.outputs[d]
        states.append(hs)
        kept.append(saved)
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    error = p
    error[:, np.arange(n), labels] -= 1
    error *= (weight / weight.sum())[:, :, None]
    tables, recurrent, biases, outputs = [], [], [], []
    for d in range(2):
        u, out = network.recurrent[d], network.outputs[d]
        hidden = u.shape[0]
        d_table, d_u, d_bias, d_out = np.zeros((256, 3 * hidden)), np.zeros_like(u), np.zeros(hidden), np.zeros_like(out)
        d_h = np.zeros((n, hidden), np.float32)
        inputs = np.empty((steps, n, 3 * hidden), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            before, z, r, inner, c = kept[d][t]
            d_out += states[d][t].T @ error[t]
            d_h = d_h + error[t] @ out.T
            d_c = d_h * (1 - z) * (1 - np.abs(c)) ** 2
            d_z = d_h * (before - c) * _gate_slope(z)
            d_inner = d_c * r
            d_r = d_c * inner * _gate_slope(r)
            d_g = np.hstack([d_z, d_r, d_inner])
            d_u += before.T @ d_g
            d_bias += d_inner.sum(axis=0)
            inputs[t] = np.hstack([d_z, d_r, d_c])
            d_h = d_h * z + d_g @ u.T
        flat, codes_flat = inputs.reshape(-1, 3 * hidden), codes.reshape(-1)
        order = np.argsort(codes_flat, kind="stable")
        met, first = np.unique(codes_flat[order], return_index=True)
        d_table[met] = np.add.reduceat(flat[order], first, axis=0)
        tables.append(d_table)
        recurrent.append(d_u)
        biases.append(d_bias)
        outputs.append(d_out)
    return [*tables, *recurrent, *biases, *outputs, error.sum(axis=(0, 1))]


def fit(excerpts: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 1) -> Network:
    """Train on (bytes, language). Languages are drawn equally often; the learning rate falls to nothing."""
    languages = sorted({language for _, language in excerpts})
    network = new_network(languages, seed=seed)
    if len(languages) < 2:
        return network
    codes = np.full((EXCERPT, len(excerpts)), BLANK, np.int64)
    weight = np.zeros((EXCERPT, len(excerpts)), np.float32)
    for i, (raw, _) in enumerate(excerpts):
        codes[: len(raw), i] = np.frombuffer(raw, np.uint8)
        weight[: len(raw), i] = 1
    labels = np.array([languages.index(language) for _, language in excerpts])
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    rng = np.random.default_rng(seed)
    parameters = network.parameters()
    means = [np.zeros(p.shape) for p in parameters]
    squares = [np.zeros(p.shape) for p in parameters]
    for step in range(1, steps + 1):
        drawn = np.array([rng.choice(of[k]) for k in rng.integers(0, len(languages), BATCH)])
        rate = 0.02 * (1 - step / (steps + 1))
        for p, m, s, g in zip(
            parameters, means, squares, gradients(network, codes[:, drawn], labels[drawn], weight[:, drawn]), strict=True
        ):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def excerpts_of(df: DataFrame, key: str, text: str, lang: str, allowed: Column) -> list[tuple[bytes, str]]:
    """The bounded training sample: (bytes, language) from rows that ``allowed`` admits, at most SAMPLE texts of a language
    and EXCERPTS of a text, the same ones in every run. Texts are chosen on narrow rows by a hash of their id, whose cut-off
    follows the size of the language; the texts of a repeated id are told apart by their own hash, equal ones count once."""
    own = df.where(allowed & F.col(lang).isNotNull() & F.col(key).isNotNull())
    own = own.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {row["lang"]: row["count"] for row in own.groupBy("lang").count().collect()}
    if not sizes:
        return []
    chance = F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2.0 * SAMPLE / n))])
    own = own.withColumns({"chance": chance, "same": F.xxhash64("text")})
    few = own.where(F.col("chance") < share[F.col("lang")]).select("key", "lang", "chance", "same")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "key", "same"))
    picked = few.distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("key", "lang", "same")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, names = [], []
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (body or "").encode()
                for i in range(min(EXCERPTS, -(-len(raw) // EXCERPT))):
                    at = (i * 2654435761 + len(raw) * 40503) % max(1, len(raw) - EXCERPT + 1)
                    raws.append(raw[at : at + EXCERPT])
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(raws, pa.binary()), pa.array(names, pa.string())], ["raw", "lang"])

    chosen = own.join(F.broadcast(picked), ["key", "lang", "same"]).dropDuplicates(["key", "lang", "same"])
    rows = chosen.select("text", "lang").mapInArrow(cut, "raw binary, lang string")
    return sorted((bytes(row["raw"]), row["lang"]) for row in rows.collect())


def text_probabilities(network: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean position probabilities of every text of a block, (texts, languages); zeros for empty texts."""
    sizes = np.diff(bounds)
    n_segments = -(-sizes // SEGMENT)
    text_of = np.repeat(np.arange(len(sizes)), n_segments)
    within = np.arange(len(text_of)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
    starts = bounds[text_of] + within * SEGMENT
    totals = np.zeros((len(sizes), len(network.languages)))
    for a in range(0, len(starts), SIDE_BY_SIDE):
        own = slice(a, a + SIDE_BY_SIDE)
        at = starts[own] + np.arange(-CONTEXT, SEGMENT + CONTEXT)[:, None]
        inside = (at >= bounds[text_of[own]]) & (at < bounds[text_of[own] + 1])
        codes = np.where(inside, data[np.clip(at, 0, len(data) - 1)], BLANK)
        p = position_probabilities(network, codes)[CONTEXT : CONTEXT + SEGMENT]
        p *= inside[CONTEXT : CONTEXT + SEGMENT, None, :]
        np.add.at(totals, text_of[own], p.sum(axis=0, dtype=np.float64).T)
    return totals / np.maximum(sizes, 1)[:, None]


def predictions(network: Network, column: pa.Array) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for first, data, bounds in blocks(column):
        if len(network.languages):
            p = text_probabilities(network, data, bounds)
            best, top = p.argmax(axis=1), p.max(axis=1)
        for i in range(len(bounds) - 1):
            text = column[first + i].as_py()
            known = len(network.languages) > 0 and text is not None and any(c.isalpha() for c in text)
            names.append(network.languages[best[i]] if known else UNKNOWN)
            scores.append(min(1.0, float(top[i])) if known else 0.0)
    return names, scores


def fold(key: str, of: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def train(df: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    return fit(excerpts_of(df, key, text, lang, allowed))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row, learned from two of three folds."""
    network = train(df, fold(key, 3) != 1, key, text, lang)
    held_out = F.coalesce(fold(key, 3) == 1, F.lit(False))
    own = df.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))
    return predicted(own, network).withColumnRenamed("key", key)


def predicted(own: DataFrame, network: Network) -> DataFrame:
    """(key, held_out, lang_pred, score) from (key, held_out, text)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predictions(network, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["key", "held_out", "lang_pred", "score"],
            )

    schema = own.select("key", "held_out").schema.add("lang_pred", "string").add("score", "double")
    return own.mapInArrow(predict, schema)


def known_language(df: DataFrame, least: float = 0.4, key: str = "doc_id", text: str = "text", lang: str = "lang"):
    """The rows, with all their columns, whose text has a language: one language holds at least ``least`` of the
    pooled probability. At 0.4 no text of 10,000 with letters is rejected, at 0.5 three of about ten characters, two of
    them labelled rightly: so 0.4."""
    network = train(df, fold(key, 3) != 1, key, text, lang)
    at = df.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*predictions(network, batch.column(at)), strict=True)
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))

    return where_arrow(df, keep)
