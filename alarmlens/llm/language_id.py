"""Language identification with a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes, one from each end; a linear layer labels every position from both
states, and the probabilities of all positions are averaged into those of the document. The network is
trained here, in numpy, by backpropagation through time.

Texts of any length are read in full: they are cut into stretches of equal length, and many stretches
go through the network side by side. Gates use x / (1 + |x|) in place of the logistic function and the hyperbolic tangent;
it has the same shape and is cheap.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.tables import crc_remainder, id_and_text, in_slices, text_sha256

HIDDEN = 8
STRETCH = 256
LANES = 2048
PIECE = 64  # bytes of a training example
PAD = 256
UNDETERMINED = "und"


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Layer:
    """One direction: input weights by byte, recurrent weights, output weights. Columns: keep, reset, candidate."""

    inputs: np.ndarray  # [257, 3H]
    recurrent: np.ndarray  # [H, 3H]
    outputs: np.ndarray  # [H, K]


@dataclass
class Network:
    languages: list[str]
    forward: Layer
    backward: Layer
    bias: np.ndarray  # [K]


def _run(layer: Layer, data: np.ndarray, mask: np.ndarray | None, out: np.ndarray, reverse: bool) -> None:
    """Adds to ``out`` [T, lanes, K] what this direction's states give at every position of ``data`` [T, lanes]."""
    h3 = layer.recurrent.shape[1]
    size = h3 // 3
    lanes = data.shape[1]
    gates_w = np.ascontiguousarray(layer.recurrent[:, : 2 * size])
    candidate_w = np.ascontiguousarray(layer.recurrent[:, 2 * size :])
    state = np.zeros((lanes, size), np.float32)
    given = np.empty((lanes, h3), np.float32)
    gates = np.empty((lanes, 2 * size), np.float32)
    scratch = np.empty((lanes, 2 * size), np.float32)
    candidate = np.empty((lanes, size), np.float32)
    part = np.empty((lanes, size), np.float32)
    for t in range(len(data) - 1, -1, -1) if reverse else range(len(data)):
        np.take(layer.inputs, data[t], axis=0, out=given, mode="clip")
        np.matmul(state, gates_w, out=gates)
        gates += given[:, : 2 * size]
        np.abs(gates, out=scratch)
        scratch += 1
        gates /= scratch
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[:, size:], state, out=part)
        np.matmul(part, candidate_w, out=candidate)
        candidate += given[:, 2 * size :]
        np.abs(candidate, out=part)
        part += 1
        candidate /= part
        state -= candidate
        state *= gates[:, :size]
        state += candidate
        if mask is not None:
            state *= mask[t][:, None]
        out[t] += state @ layer.outputs


def _position_sums(net: Network, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[lanes, K] probabilities summed over the valid positions of each lane of ``data`` [lanes, T]."""
    longest = int(lengths.max())
    steps = np.ascontiguousarray(data[:, :longest].T)
    full = bool((lengths == longest).all())
    mask = None if full else (np.arange(longest)[:, None] < lengths[None, :]).astype(np.float32)
    out = np.empty((longest, len(data), len(net.languages)), np.float32)
    out[:] = net.bias
    _run(net.forward, steps, mask, out, False)
    _run(net.backward, steps, mask, out, True)
    out -= out.max(axis=2, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=2, keepdims=True)
    if mask is not None:
        out *= mask[:, :, None]
    return out.sum(axis=0, dtype=np.float64)


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """[texts, K]: position probabilities averaged over the whole of each text; an even spread for an empty one."""
    kinds = len(net.languages)
    sizes = np.array([len(t) for t in texts], np.int64)
    stretches = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), stretches)
    first = np.cumsum(stretches) - stretches
    nth = np.arange(len(owner)) - first[owner]
    lengths = np.minimum(sizes[owner] - nth * STRETCH, STRETCH)
    starts = (np.cumsum(sizes) - sizes)[owner] + nth * STRETCH
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sums = np.zeros((len(texts), kinds))
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        places = np.minimum(starts[lanes][:, None] + np.arange(int(lengths[lanes[0]])), max(len(raw) - 1, 0))
        data = raw[places].astype(np.intp)
        data[np.arange(data.shape[1]) >= lengths[lanes][:, None]] = PAD
        np.add.at(sums, owner[lanes], _position_sums(net, data, lengths[lanes]))
    return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 1 / max(kinds, 1))


def _unroll(layer: Layer, data: np.ndarray, mask: np.ndarray, reverse: bool):
    """States of every step and what backpropagation needs."""
    size = layer.recurrent.shape[0]
    state = np.zeros((data.shape[1], size))
    states, kept = np.zeros((len(data), data.shape[1], size)), {}
    for t in range(len(data) - 1, -1, -1) if reverse else range(len(data)):
        given = layer.inputs[data[t]]
        soft = _soft(given[:, : 2 * size] + state @ layer.recurrent[:, : 2 * size])
        gates = 0.5 + 0.5 * soft
        keep, reset = gates[:, :size], gates[:, size:]
        candidate = _soft(given[:, 2 * size :] + (reset * state) @ layer.recurrent[:, 2 * size :])
        kept[t] = (state, soft, keep, reset, candidate)
        state = (candidate + keep * (state - candidate)) * mask[t][:, None]
        states[t] = state
    return states, kept


def _through_time(layer: Layer, data: np.ndarray, mask: np.ndarray, kept: dict, error: np.ndarray, reverse: bool):
    """Gradients of the input and recurrent weights from ``error`` [T, lanes, H] on the states."""
    size = layer.recurrent.shape[0]
    inputs, recurrent = np.zeros_like(layer.inputs), np.zeros_like(layer.recurrent)
    carried = np.zeros(error.shape[1:])
    given = np.empty((*data.shape, 3 * size))
    for t in range(len(data)) if reverse else range(len(data) - 1, -1, -1):
        before, soft, keep, reset, candidate = kept[t]
        d = (carried + error[t]) * mask[t][:, None]
        d_candidate = d * (1 - keep) * (1 - np.abs(candidate)) ** 2
        through = d_candidate @ layer.recurrent[:, 2 * size :].T
        d_gates = np.hstack([d * (before - candidate), through * before]) * 0.5 * (1 - np.abs(soft)) ** 2
        recurrent[:, 2 * size :] += (reset * before).T @ d_candidate
        recurrent[:, : 2 * size] += before.T @ d_gates
        given[t, :, : 2 * size], given[t, :, 2 * size :] = d_gates, d_candidate
        carried = d * keep + through * reset + d_gates @ layer.recurrent[:, : 2 * size].T
    np.add.at(inputs, data.ravel(), given.reshape(-1, 3 * size))
    return inputs, recurrent


def train(
    examples: list[tuple[bytes, str]], steps: int = 220, batch: int = 192, hidden: int = HIDDEN, seed: int = 11
) -> Network:
    """Fit on byte strings with their language: every position is to be labelled with it. Languages weigh alike."""
    examples = [(raw[:PIECE], language) for raw, language in examples if raw]
    languages = sorted({language for _, language in examples})
    rng = np.random.default_rng(seed)
    kinds = max(len(languages), 1)

    def layer() -> Layer:
        return Layer(
            rng.normal(0, 0.5, (257, 3 * hidden)), rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), rng.normal(0, 0.3, (hidden, kinds))
        )

    net = Network(languages, layer(), layer(), np.zeros(kinds))
    weights = [net.bias] + [w for side in (net.forward, net.backward) for w in (side.inputs, side.recurrent, side.outputs)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    of_language = [[raw for raw, x in examples if x == language] for language in languages]
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        target = rng.integers(0, kinds, batch)
        chosen = [of_language[k][rng.integers(len(of_language[k]))] for k in target]
        data = np.full((batch, PIECE), PAD, np.intp)
        for i, raw in enumerate(chosen):
            data[i, : len(raw)] = np.frombuffer(raw, np.uint8)
        data = data.T.copy()
        mask = (data != PAD).astype(float)
        logits = np.broadcast_to(net.bias, (*data.shape, kinds)).copy()
        runs = []
        for side, reverse in ((net.forward, False), (net.backward, True)):
            states, kept = _unroll(side, data, mask, reverse)
            logits += states @ side.outputs
            runs.append((side, reverse, states, kept))
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(batch), target] -= 1
        error = p * mask[:, :, None] / mask.sum()
        gradients = [error.sum(axis=(0, 1))]
        for side, reverse, states, kept in runs:
            inputs, recurrent = _through_time(side, data, mask, kept, error @ side.outputs.T, reverse)
            gradients += [inputs, recurrent, np.einsum("tbh,tbk->hk", states, error)]
        rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, (m, v) in zip(weights, gradients, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def single(side: Layer) -> Layer:
        return Layer(*(np.ascontiguousarray(w, np.float32) for w in (side.inputs, side.recurrent, side.outputs)))

    return Network(languages, single(net.forward), single(net.backward), net.bias.astype(np.float32))


def training_examples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int, per_language: int):
    """Up to about ``per_language`` documents of each language, three pieces from each, at places set by a hash."""
    known = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")
    ).filter("text is not null and lang is not null").filter(crc_remainder("id", folds) != fold)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(min(1.0, per_language / n)))])[F.col("lang")]
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1_000_000
    size = F.greatest(F.length("text") - PIECE, F.lit(1))
    starts = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), size) + 1 for k in range(3)])
    pieces = known.filter(place < share).select("id", "lang", F.posexplode(starts).alias("k", "start"), "text")
    rows = pieces.select("lang", F.substring(F.col("text"), F.col("start").cast("int"), F.lit(PIECE)).alias("piece")).collect()
    return sorted((r["piece"].encode("utf-8", "replace"), r["lang"]) for r in rows)  # bounded by languages x per_language


def languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    fold: int = 2,
    per_language: int = 800,
    learn_from: DataFrame | None = None,
    steps: int = 220,
    digests: bool = False,
) -> DataFrame:
    """Per row: id, held_out, lang_pred, score; with ``digests`` also text_sha256.

    Trained on ``learn_from`` (by default ``docs``): on text and non-null language of rows whose id's crc32 modulo ``folds`` is not ``fold``, at most about
    ``per_language`` of each language. ``und`` with score 0 where the text is null or has no letter, or where nothing could be
    learned. Repeated rows give repeated rows.
    """
    net = train(training_examples(docs if learn_from is None else learn_from, id_col, text_col, lang_col, folds, fold, per_language), steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(1).to_pylist()
            legible = np.array([bool(net.languages) and any(map(str.isalpha, t)) for t in texts], bool)
            probabilities = document_probabilities(net, [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, legible)])
            best = probabilities.argmax(axis=1) if probabilities.size else np.zeros(len(texts), int)
            names = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(best, legible)]
            scores = np.where(legible, probabilities.max(axis=1, initial=0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores), *batch.columns[2:]],
                names=["id", "lang_pred", "score", *more],
            )

    source = id_and_text(docs, id_col, text_col)
    more = ["text_sha256"] if digests else []
    if digests:
        source = source.select("id", "text", text_sha256("text"))
    schema = "id long, lang_pred string, score double" + "".join(f", {name} string" for name in more)
    return source.mapInArrow(run, schema).select(
        F.col("id").alias(id_col), (crc_remainder("id", folds) == fold).alias("held_out"), "lang_pred", "score", *more
    )
