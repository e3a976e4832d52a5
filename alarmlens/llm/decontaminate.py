"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Texts become words; every ``gram`` consecutive words have a 64-bit hash, and of each ``window - gram + 1``
consecutive hashes the smallest is kept as a fingerprint. Two texts that share ``window`` consecutive words
share at least one of those fingerprints, at the same place of the shared span. Fingerprints of the documents are joined
with those of the items; around each place that matches, the hit is extended to every span of
``window`` words that holds it, and these spans are compared as whole texts with the items' spans.

Items shorter than ``window`` words are one span of their own length; for each such length that occurs, every span
of that length is a fingerprint (a gram as long as the span leaves one hash per window).

The document side is never grouped by fingerprint, so a passage that a third of all documents holds makes
no hot group: the join's other side is the items' distinct fingerprints, which Spark broadcasts
if they are small and splits if they are skewed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.tables import ALPHA_LOWER, ALPHA_UPPER, text_sha256
from alarmlens.runtime import materialize

WINDOW = 10
GRAM = 5
PLACE_BITS = 30  # no text has more words
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; everything in ASCII but letters and digits separates. Null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), ALPHA_UPPER, ALPHA_LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _gram(size: int) -> str:
    """SQL for the hash of the ``size`` consecutive word hashes from place ``i`` of ``h``."""
    return f"xxhash64({', '.join(f'h[i + {k}]' for k in range(size))})"


def _fingerprints(texts: DataFrame, gram: int, window: int, shorter: tuple[int, ...] = ()) -> DataFrame:
    """``words`` replaced by ``(size, own, at, fp)``: hashes of ``own`` words that some window of ``size`` words selects, and
    their first word's place from 0. A text of fewer than ``window`` words has no fingerprint of that size.

    Hash and place are one number, hash above, so one minimum gives the leftmost of the smallest hashes and the choice
    depends on the window's words alone. Of the sizes in ``shorter`` every span is a gram of its own length.
    All sizes come from one pass over the words.
    """
    kept = [c for c in texts.columns if c != "words"]
    # The barrier keeps the optimizer from moving the splitting of the text into the lambdas below.
    hashed = texts.select(*kept, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    hashed = hashed.select(F.inline(F.array(F.struct(*kept, "h"))))
    packed = f"shiftleft(shiftrightunsigned({_gram(gram)}, {PLACE_BITS}), {PLACE_BITS}) | i"
    grams = hashed.withColumn(
        "g", F.expr(f"if(size(h) < {window}, array(), transform(sequence(0, size(h) - {gram}), i -> {packed}))")
    )
    width = window - gram + 1
    least = f"least({', '.join(f'g[s + {k}]' for k in range(width))})" if width > 1 else "g[s]"
    smallest = f"array_distinct(transform(sequence(0, size(g) - {width}), s -> {least}))"
    chosen = grams.withColumn("chosen", F.expr(f"if(size(h) < {window}, array(), {smallest})"))
    mask = (1 << PLACE_BITS) - 1
    found = [
        f"transform(chosen, p -> struct({window} as size, {gram} as own, cast(p & {mask}L as int) as at, "
        f"shiftrightunsigned(p, {PLACE_BITS}) as fp))"
    ]
    found += [
        f"if(size(h) < {n}, array(), transform(sequence(0, size(h) - {n}), "
        f"i -> struct({n} as size, {n} as own, i as at, {_gram(n)} as fp)))"
        for n in shorter
    ]
    return chosen.select(*kept, F.inline(F.expr(f"concat({', '.join(found)})")))


def _spans(items: DataFrame, window: int) -> DataFrame:
    """``(item, span, size)``: every window of an item as text; a shorter item is one span."""
    texts = F.expr("transform(sequence(1, size(words) - size + 1), s -> array_join(slice(words, s, size), ' '))")
    sized = items.filter(F.size("words") > 0).withColumn("size", F.least(F.lit(window), F.size("words")))
    return sized.select("item", "size", F.explode(texts).alias("span")).distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    digests: bool = False,
) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items (sorted item ids as strings), contaminated; with ``digests``
    also text_sha256.

    A word is hit if it lies in any occurrence of an item's span. Null and empty texts have no words and
    are never contaminated; items without words are left out, those without an id are one item named None, and an empty benchmark hits nothing. Rows that
    share an id but not their text are judged apart; repeated rows give repeated rows.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("None")).alias("item"), words(F.col(item_text_col)).alias("words"))
    items = materialize(items, "items")
    spans = materialize(_spans(items, window), "item_spans")
    raw = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("row"),
        F.xxhash64(F.col(text_col)).alias("version"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )
    more = ["text_sha256"] if digests else []
    counted = raw.select(
        "row", "version", "id", F.size(words(F.col("text"))).cast("long").alias("n_words"), *[text_sha256("text") for _ in more]
    )

    sizes = [r["size"] for r in spans.select("size").distinct().orderBy("size").collect()]  # at most ``window`` numbers
    shorter = tuple(n for n in sizes if n < window)
    fits = F.least(F.lit(window), F.size("words")).alias("fits")
    keys = _fingerprints(items.withColumn("fits", fits), gram, window, shorter).filter("size = fits")
    keys = materialize(keys.select("size", "fp").distinct(), "item_prints")
    texts = raw.select("row", "version", words(F.col("text")).alias("words"))
    places = _fingerprints(texts, gram, window, shorter).join(keys, ["size", "fp"], "left_semi")
    of_text = places.groupBy("row", "version").agg(F.collect_set(F.struct("at", "size", "own")).alias("places"))
    of_text = materialize(of_text, "places")

    # Every span of ``size`` words that holds the gram, compared word for word. Start and size travel as one
    # number, and the spans are cut inside the row, so the words of a long text are not copied for each place.
    base = window + 1
    starts = F.expr(
        "array_distinct(flatten(transform(places, p -> transform("
        f"sequence(greatest(p.at + p.own - p.size, 0), least(p.at, size(words) - p.size)), s -> s * {base}L + p.size))))"
    )
    cut = F.expr(
        f"transform(starts, c -> struct(cast(c % {base} as int) as size, cast(c div {base} as int) as start, "
        f"array_join(slice(words, cast(c div {base} as int) + 1, cast(c % {base} as int)), ' ') as span))"
    )
    around = (
        raw.select("row", "version", "text")
        .join(of_text, ["row", "version"])
        .withColumn("words", words(F.col("text")))
        .withColumn("starts", starts)
        .select("row", "version", F.inline(cut))
    )
    hits = around.join(spans.select("span", "size").distinct(), ["span", "size"], "left_semi").distinct()
    hits = materialize(hits, "hit_spans")

    # Words covered by the spans: in order of their starts, what each adds beyond the last end.
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["stop"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    n_hit = hits.groupBy("row", "version").agg(covered.alias("n_hit"))
    met = hits.select("row", "version", "span", "size").distinct().join(spans, ["span", "size"])
    items_met = met.groupBy("row", "version").agg(F.array_sort(F.collect_set("item")).alias("items"))
    report = n_hit.join(items_met, ["row", "version"])
    none = F.array().cast("array<string>")
    return counted.join(report, ["row", "version"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *more,
    )
