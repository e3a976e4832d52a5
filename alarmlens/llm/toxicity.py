"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (one per telling word or word beginning) and pattern voters (shouting,
marks, repetition). A generative label model holds, for each class, the rate at which each voter fires, estimated by
expectation-maximisation over the votes of all documents, and the correlation of voters within a class, by which
voters that agree share their evidence. Its posterior labels train a linear classifier on hashed words, word
beginnings and votes, which scores every text.

Labels are used to find the lexicon and to start the label model, and all learnable labels count; what a voter is worth
comes from all documents. Every term is a voter that passes a test for a false-discovery level; of labelled near copies (five-word
shingles) one counts, so that chance words of a much copied text don't look telling.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.tables import bounded_sample, crc_remainder, id_and_text, in_slices, summed
from alarmlens.runtime import materialize

FALSE_DISCOVERIES = 1e-3
LEAST_RATIO = 4.0  # how much more often a voter has to stand in texts of label 1
LABEL_BITS = 18  # words of 64 bits in the filter that keeps unlabelled texts from moving
BEGINNINGS = (4, 5, 6)
DIMENSIONS = 1 << 14
PATTERNS = 5
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """Lower-case words of the text, and their beginnings marked with ``*``."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for size in BEGINNINGS:
        found.update(w[:size] + "*" for w in words if len(w) > size)
    return found


def patterns(text: str) -> list[bool]:
    """Shouting, exclamation, symbols, word repeated at once, very long word."""
    n = max(len(text), 1)
    words = text.split()
    upper = sum(map(str.isupper, words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        upper * 5 > len(words) > 4,
        text.count("!") * 60 > n,
        (text.count("*") + text.count("$") + text.count("%") + text.count("&")) * 40 > n,
        repeats * 10 > len(words),
        max(map(len, words), default=0) > 40,
    ]


@dataclass
class LabelModel:
    """Rates at which voters fire per class, their correlations within a class, share of label 1."""

    fire: np.ndarray  # [2, voters]
    correlation: np.ndarray  # [voters, voters], diagonal zero
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of label 1. Voters that agree share their evidence by how much they are correlated:
        a voter among those that fired (or kept silent) counts 1 / (1 + its correlations with the others)."""
        fired = np.log(self.fire[1] / self.fire[0])
        silent = np.log((1 - self.fire[1]) / (1 - self.fire[0]))
        quiet = 1 - votes
        z = np.log(self.prior / (1 - self.prior))
        z = z + (votes * fired / (1 + votes @ self.correlation)).sum(axis=1)
        z = z + (quiet * silent / (1 + quiet @ self.correlation)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Scorer:
    """What a task needs: the lexicon and the weights of the linear classifier."""

    lexicon: dict[str, int]
    weights: np.ndarray  # hashed terms, then votes, then the intercept

    @property
    def voters(self) -> int:
        return len(self.lexicon) + PATTERNS

    def votes(self, text: str, found: set[str]) -> np.ndarray:
        out = np.zeros(self.voters, np.float32)
        for term in found & self.lexicon.keys():
            out[self.lexicon[term]] = 1
        out[len(self.lexicon) :] = patterns(text)
        return out

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """Places of the hashed terms, their common weight, votes; the length is normalised away."""
        found = terms(text)
        places = np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) & DIMENSIONS - 1 for t in found), np.int64, len(found))
        return places, self.votes(text, found), 1 / max(len(found), 1) ** 0.5

    def score(self, text: str) -> float:
        places, votes, weight = self.features(text)
        z = weight * self.weights[places].sum() + votes @ self.weights[DIMENSIONS:-1] + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def find_lexicon(
    known: DataFrame, totals: dict[int, int], level: float = FALSE_DISCOVERIES, ratio: float = LEAST_RATIO
) -> dict[str, int]:
    """Terms of ``(text, label)`` that stand in texts of label 1 more than ``ratio`` times as often as in those of label 0, beyond
    what chance allows. ``totals``: rows per label.

    A term's p-value is bounded by Chernoff: texts that hold it, times the divergence between their share of label 1 and the
    share that ``ratio`` itself would give. A test against the ratio keeps weak terms out however many rows there are. Benjamini and Hochberg's rule over all terms keeps the share of chance terms below ``level``. Of a word and
    its beginnings, which say the same thing, the most telling one stays.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}

        def flush():
            names = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([seen[k][t] for t in names], pa.int64()) for k in (0, 1))]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "n0", "n1"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(terms(text))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield flush()
        yield flush()

    if len(totals) < 2:
        return {}
    counted = known.select("text", "label").mapInArrow(count, "term string, n0 long, n1 long")
    counted = materialize(counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "terms")
    tests = counted.count()
    base = ratio * totals[1] / (totals[0] + ratio * totals[1])
    n, share = F.col("n0") + F.col("n1"), F.col("n1") / (F.col("n0") + F.col("n1"))
    against = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    bound = -n * (share * F.log(share / base) + against)
    likely = counted.filter((F.col("n1") > 0) & (share > base)).withColumn("log_p", bound).filter(F.col("log_p") <= float(np.log(level)))
    rows = likely.orderBy("log_p", "term").collect()  # terms that may pass: a matter of the vocabulary, not of the rows
    passed = 0
    for k, row in enumerate(rows, 1):
        if row["log_p"] <= np.log(level * k / tests):
            passed = k
    chosen: list[str] = []
    kept: set[str] = set()
    prefixes: set[str] = set()
    for row in rows[:passed]:
        stem = row["term"].rstrip("*")
        if stem not in prefixes and not any(stem[:i] in kept for i in range(1, len(stem) + 1)):
            chosen.append(row["term"])
            kept.add(stem)
            prefixes.update(stem[:i] for i in range(1, len(stem) + 1))
    return {term: i for i, term in enumerate(sorted(chosen))}


def shingle_key(text: str, size: int = 5) -> int:
    """Smallest hash of the text's five-word shingles: near copies share it about as often as they share shingles."""
    words = text.lower().split()
    if len(words) <= size:
        return zlib.crc32(" ".join(words).encode("utf-8", "replace"))
    own = [zlib.crc32(w.encode("utf-8", "replace")) for w in words]
    h = np.array(own, np.uint64)
    mixed = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return int(mixed.min() >> np.uint64(1))


def _keyed(rows: DataFrame) -> DataFrame:
    """``(id, h, near)`` of ``(id, h, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            near = pa.array([shingle_key(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), near], names=["id", "h", "near"])

    return rows.select("id", "h", "text").mapInArrow(run, "id long, h long, near long")


def _may_be_in(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows whose key may be among ``keys``, by a filter of at most 2^LABEL_BITS words, which is what is broadcast. A fuller
    filter lets more rows pass, never fewer than are wanted."""
    parts = [F.expr(f"shiftrightunsigned(_key, {64 - LABEL_BITS})").alias("_word"), F.expr("shiftleft(1L, cast(_key & 63 as int))").alias("_bit")]
    words = keys.select(F.xxhash64(*names).alias("_key")).select(*parts).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_key", F.xxhash64(*names)).select(*rows.columns, *parts)
    met = marked.join(F.broadcast(materialize(words, "label_words")), "_word")
    return met.filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns)


def cast_votes(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``(id, votes)`` with the voters that fired, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            fired = [np.flatnonzero(scorer.votes(t, terms(t))).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fired, pa.list_(pa.int32()))], names=["id", "votes"])

    return docs.mapInArrow(run, "id long, votes array<int>")


def _unpack(votes: pa.Array, voters: int) -> np.ndarray:
    fired = np.zeros((len(votes), voters))
    rows = np.repeat(np.arange(len(votes)), np.asarray(votes.value_lengths()))
    fired[rows, votes.flatten().to_numpy()] = 1
    return fired


def _expectations(votes: DataFrame, model: LabelModel) -> np.ndarray:
    """[2, voters + 1, voters + 1] weighted counts per class of pairs of voters; the last voter always fires."""
    voters = len(model.correlation)
    side = voters + 1
    upper = np.triu_indices(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, side, side))
        for batch in in_slices(batches):
            if not batch.num_rows:
                continue
            fired = _unpack(batch.column(0), voters)
            weight = batch.column(1).to_numpy().astype(np.float64)
            p = model.posterior(fired)
            full = np.hstack([fired, np.ones((len(fired), 1))])
            for label, share in enumerate((1 - p, p)):
                total[label] += (full * (share * weight)[:, None]).T @ full
        values = np.concatenate([t[upper] for t in total])
        met = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(values[met])], names=["place", "value"])

    found = summed(votes.select("votes", "n").mapInArrow(run, "place int, value double"))
    values = np.zeros(2 * len(upper[0]))
    values[list(found.keys())] = list(found.values())
    total = np.zeros((2, side, side))
    for label, own in enumerate(np.split(values, 2)):
        total[label][upper] = own
        total[label] += np.triu(total[label], 1).T
    return total


def _correlations(pairs: np.ndarray, least: float = 20) -> np.ndarray:
    """Positive correlation of two voters within a class, the larger of both classes; voters that a class shows fewer
    than ``least`` times are taken as independent there."""
    together = np.zeros((pairs.shape[1] - 1,) * 2)
    for of_class in pairs:
        n = max(of_class[-1, -1], 1e-9)
        share, rate = of_class[:-1, :-1] / n, of_class[:-1, -1] / n
        deviation = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
        correlation = (share - np.outer(rate, rate)) / np.outer(deviation, deviation)
        enough = rate * n >= least
        together = np.maximum(together, np.where(np.outer(enough, enough), np.clip(correlation, 0, 1), 0))
    np.fill_diagonal(together, 0)
    return together


def fit_label_model(votes: DataFrame, known: DataFrame, voters: int, rounds: int = 6) -> LabelModel:
    """Start from labelled votes ``(votes, label)``, then expectation-maximisation over ``(votes)`` of all documents.

    Each round is one pass over the distinct vote patterns with their counts. The rates stay tied to
    the labelled start by as many imaginary rows as it had, so the classes cannot change places.
    """
    known = materialize(known.select("label", "votes"), "labelled_votes")
    rows = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([rows.get(k, 0) for k in (0, 1)], float)
    fired = np.zeros((2, voters))
    for r in known.select("label", F.explode("votes").alias("voter")).groupBy("label", "voter").agg(F.count(F.lit(1)).alias("n")).collect():
        fired[r["label"], r["voter"]] = r["n"]
    tied = (fired + 0.5) / (n[:, None] + 1)
    model = LabelModel(tied, np.zeros((voters, voters)), float((n[1] + 1) / (n.sum() + 2)))
    weight = np.maximum(n, 1)
    patterns_seen = materialize(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "vote_patterns")
    for _ in range(rounds):
        pairs = _expectations(patterns_seen, model)
        counts = pairs[:, -1, -1]
        fire = (pairs[:, :-1, -1] + weight[:, None] * tied) / (counts + weight)[:, None]
        fire = np.clip(fire, 1e-5, 1 - 1e-5)
        model = LabelModel(fire, _correlations(pairs), float(np.clip((counts[1] + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4)))
    return model


def fit_classifier(rows: list[tuple[str, float]], lexicon: dict[str, int], steps: int = 400, seed: int = 3) -> Scorer:
    """Logistic regression on posterior labels, by Adam over mini-batches; classes weigh alike."""
    scorer = Scorer(lexicon, np.zeros(DIMENSIONS + len(lexicon) + PATTERNS + 1))
    if not rows:
        return scorer
    made = [scorer.features(text) for text, _ in rows]
    target = np.array([p for _, p in rows])
    mass = np.array([(1 - target).sum(), target.sum()]) + 1e-9
    balance = np.where(target > 0.5, len(target) / (2 * mass[1]), len(target) / (2 * mass[0]))
    balance = np.clip(balance, 0.1, 6)
    rng = np.random.default_rng(seed)
    w = scorer.weights
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(rows), 64)
        gradient = 2e-4 * w
        for i in chosen:
            places, votes, weight = made[i]
            z = weight * w[places].sum() + votes @ w[DIMENSIONS:-1] + w[-1]
            error = balance[i] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target[i]) / len(chosen)
            np.add.at(gradient, places, error * weight)
            gradient[DIMENSIONS:-1] += error * votes
            gradient[-1] += error
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return scorer


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    max_training: int = 6_000,
) -> DataFrame:
    """Per row: id, held_out, score, predicted. Labels are read only where the id's crc32 modulo ``folds`` is not 0.

    The lexicon and the start of the label model come from all of them (of near copies with one label the lexicon counts
    one), the classifier from the posterior labels of about ``max_training``, as many of each label if there are
    enough; votes, rates and correlations cover all documents. Null texts count as empty. Without labels of both classes no term is
    found, and the score is near the share of label 1 seen. Very long texts are scored whole; repeated rows give repeated rows.
    Terms with equal p-values are taken in the order of their names.
    """
    source = id_and_text(docs, id_col, text_col)
    wanted = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & (crc_remainder("id", folds) != 0))
        .distinct()
    )
    wanted = materialize(wanted, "wanted")
    # One row (id, h) for each text and label, of near copies one; ``n`` rows of the table are equal to it. Texts move once,
    # labelled ones alone, and by key whatever their number.
    hashed = source.withColumn("h", F.xxhash64("text"))
    named = _keyed(_may_be_in(hashed, wanted, "id")).join(wanted.hint("merge"), "id")
    named = named.groupBy("id", "h", "near", "label").agg(F.count(F.lit(1)).alias("n"))
    known = named.groupBy("near", "label").agg(F.min(F.struct("id", "h", "n")).alias("row")).select("label", "row.*")
    known = materialize(known, "labelled")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    moved = _may_be_in(hashed, known, "id", "h").join(known.hint("merge"), ["id", "h"])
    moved = materialize(moved.select("id", "h", "text", "label", "n"), "labelled_texts")
    shown = moved.filter("n = 1").unionByName(moved.filter("n > 1").dropDuplicates(["id", "h", "label"]))
    lexicon = find_lexicon(shown, totals)
    empty = Scorer(lexicon, np.zeros(0))
    votes = materialize(cast_votes(source, empty), "votes")
    model = fit_label_model(votes, votes.join(wanted, "id"), empty.voters)
    texts, left = set(), max_training
    for at, label in enumerate(sorted(totals, key=totals.get)):  # the rarer label first; what it leaves is the other's
        bound = left // (len(totals) - at)
        left -= min(bound, totals[label])
        drawn = bounded_sample(moved.filter(F.col("label") == label), bound, "h")
        texts.update(r["text"] for r in drawn.select("text").distinct().collect())  # ``bound``
    texts = sorted(texts)
    posteriors = model.posterior(np.array([empty.votes(t, terms(t)) for t in texts]).reshape(-1, empty.voters))
    scorer = fit_classifier(list(zip(texts, posteriors.tolist())), lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            scores = pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    return source.mapInArrow(run, "id long, score double").select(
        F.col("id").alias(id_col),
        (crc_remainder("id", folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
