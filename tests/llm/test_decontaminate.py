import random
import re

import pytest

from alarmlens.llm.decontaminate import _fingerprints, contamination, words
from pyspark.sql import functions as F


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def plain(docs, items):
    spans = {}
    for item, text in items:
        w = plain_words(text)
        size = min(10, len(w))
        for s in range(len(w) - size + 1) if w else ():
            spans.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    out = []
    for i, text in docs:
        w = plain_words(text)
        hit, met = set(), set()
        for size in {len(s) for s in spans}:
            for s in range(len(w) - size + 1):
                if (span := tuple(w[s : s + size])) in spans:
                    hit.update(range(s, s + size))
                    met |= spans[span]
        out.append((i, len(w), len(hit), len(met), sorted(met), bool(hit)))
    return sorted(map(str, out))


def check(spark, docs_of, docs, items):
    benchmark = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, words string")
    got = [tuple(r) for r in contamination(docs_of(docs), benchmark).collect()]
    assert sorted(map(str, got)) == plain(docs, items)


@pytest.mark.parametrize("seed,vocabulary", [(1, 3), (2, 12), (3, 400)])
def test_random_texts(spark, docs_of, seed, vocabulary):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice([w, w.upper(), w + ","]) for w in rng.choices([f"v{k}é" for k in range(vocabulary)], k=n))
    items = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(12)]
    docs = [(i, text(rng.choice([0, 5, 30]))) for i in range(20)]
    for i in range(20, 40):
        inside = rng.choice(items)[1].split(" ")
        cut = rng.randrange(len(inside))
        docs.append((i, text(8) + " " + " ".join(inside[cut : cut + 25]) + " " + text(8)))
    check(spark, docs_of, docs, items)


def test_odd_rows(spark, docs_of, odd_rows):
    check(spark, docs_of, odd_rows, [(1, None), (2, ""), (3, "aé B"), (3, "aé B"), (None, "word5 word6 word7"), (5, odd_rows[7][1][:4000])])
    check(spark, docs_of, odd_rows, [])
    check(spark, docs_of, odd_rows, [(1, None), (2, "?!")])
    check(spark, docs_of, [], [(1, "a b")])


def test_every_span_of_a_window_shares_a_fingerprint(spark):
    rng = random.Random(5)
    common = [f"c{k}" for k in rng.choices(range(30), k=10)]
    rows = [(i, " ".join([f"x{rng.random()}" for _ in range(rng.randrange(9))] + common + [f"y{rng.random()}"] * rng.randrange(4))) for i in range(30)]
    texts = spark.createDataFrame(rows, "i long, t string").select("i", words(F.col("t")).alias("words"))
    found = {}
    for r in _fingerprints(texts, 5, 10).collect():
        found.setdefault(r["i"], set()).add(r["fp"])
    assert set.intersection(*found.values())


def test_text_is_split_once_for_all_sizes(spark, docs_of, odd_rows):
    texts = docs_of(odd_rows).select("doc_id", words(F.col("text")).alias("words"))
    plan = _fingerprints(texts, 5, 10, (3, 4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
