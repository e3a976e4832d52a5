import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.llm import language_id, toxicity
from alarmlens.llm.quality import FEATURES, quality_scores, statistics
from alarmlens.llm.toxicity import toxicity_scores
from alarmlens.llm.url_filter import FOLDS, RULES, _with_suffixes, held_out_accuracy, host_of, judge, path_of, rule_of

LABELS = "doc_id long, quality int, toxic int, text string"


def held(i, modulus, remainder):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == remainder


def made(seed, n=240):
    """Texts with a label: toxic ones hold a word of a short list, poor ones shout or repeat."""
    rng = random.Random(seed)
    words = ["river", "stone", "quiet", "market", "evening", "paper", "garden", "window"]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(12, 60))
        toxic, quality = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            for w in rng.sample(["grubber", "snotface", "dimwit"], 2):
                text.insert(rng.randrange(len(text)), w)
        out = " ".join(text) + "."
        docs.append((i, out if quality else out.upper().replace(" ", "!! ")))
        labels.append((i, quality, toxic, "clash"))
    return docs, labels


@pytest.mark.parametrize("score,label,column,threshold", [(quality_scores, 1, "quality", 0.3), (toxicity_scores, 2, "toxic", 0.5)])
def test_labels_are_learned(spark, docs_of, odd_rows, score, label, column, threshold):
    docs, labels = made(5)
    odd = [(None if i is None else i + 1000, t) for i, t in odd_rows]
    more = [(None, 1, 1, ""), (3, None, None, ""), (9999, 7, 7, "")]
    got = score(docs_of(docs + odd), spark.createDataFrame(labels + more, LABELS)).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {r[0]: r[label] for r in labels}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(right) >= 0.9 * len(right) > 0
    for r in got:
        assert r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= threshold)


def test_labels_of_held_out_rows_are_not_read(spark, docs_of):
    docs, labels = made(6, 80)
    turned = [(i, 1 - q, 1 - t, c) if held(i, 5, 0) else (i, q, t, c) for i, q, t, c in labels]
    for score in (quality_scores, toxicity_scores):
        a, b = (
            {r["doc_id"]: round(r["score"], 9) for r in score(docs_of(docs), spark.createDataFrame(x, LABELS)).collect()}
            for x in (labels, turned)
        )
        assert a == b


def test_no_labels_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    for score in (quality_scores, toxicity_scores):
        assert all(0 <= r["score"] <= 1 for r in score(docs_of([(1, "a"), (2, None)]), none).collect())
        assert score(docs_of([]), none).count() == 0


def test_statistics_are_finite():
    for text in ("", " ", "\n" * 50, "é" * 9, "!" * 400, "a " * 5000, "Ab1 " * 9, "\ud800"):
        assert len(statistics(text)) == FEATURES and np.isfinite(statistics(text)).all()


def test_backpropagation_through_time_equals_differences():
    rng = np.random.default_rng(4)
    layer = language_id.Layer(rng.normal(size=(257, 9)), rng.normal(size=(3, 9)), rng.normal(size=(3, 2)))
    data = rng.integers(0, 5, (6, 4))
    mask = np.ones((6, 4))
    mask[4:, 1] = 0
    error = rng.normal(size=(6, 4, 3))
    for reverse in (False, True):
        _, kept = language_id._unroll(layer, data, mask, reverse)
        inputs, recurrent = language_id._through_time(layer, data, mask, kept, error, reverse)
        for weights, gradient in ((layer.inputs, inputs), (layer.recurrent, recurrent)):
            for at in [(0, 0), (1, 4), (2, 8)]:
                values = []
                for step in (1e-6, -1e-6):
                    weights[at] += step
                    values.append((language_id._unroll(layer, data, mask, reverse)[0] * error).sum())
                    weights[at] -= step
                assert abs((values[0] - values[1]) / 2e-6 - gradient[at]) < 1e-5


def test_languages(docs_of, odd_rows):
    rng = random.Random(8)
    kinds = {"aa": ["tha", "wen", "ing"], "bb": ["ou", "eau", "é"], "cc": ["zk", "pf", "ß"]}
    lang = lambda i: None if i is None or i % 11 == 0 else sorted(kinds)[i % 3]
    rows = [(i, " ".join("".join(rng.choices(kinds[sorted(kinds)[i % 3]], k=3)) for _ in range(rng.choice([4, 30, 400])))) for i in range(90)]
    odd = [(None if i is None else 3 * i + 3000, t) for i, t in odd_rows] + [(5000, "123 !?")]
    got = language_id.languages(docs_of(rows + odd, lang), steps=60).collect()
    assert len(got) == len(rows) + len(odd)
    text = dict(rows + odd)
    for r in got:
        assert r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text[r["doc_id"]] or "")))
    right = [r["lang_pred"] == sorted(kinds)[r["doc_id"] % 3] for r in got if r["doc_id"] is not None and r["doc_id"] < 90 and r["held_out"]]
    assert sum(right) >= 0.9 * len(right) > 0
    assert {r["lang_pred"] for r in language_id.languages(docs_of(rows)).collect()} == {"und"}  # nothing to learn from
    assert language_id.languages(docs_of([])).count() == 0


URLS = [
    None, "", "no scheme/en/", "http://", "http://net", "http://NET/", "https://a.b.example.NET/en/x?y=1#z", "http://example.net/e",
    "http://xexample.net/en/1", "https://example.com/de/", "https://m.example.com/DE/", "x://org/fr/?q", "http://a.org/fr", "http://b.org/fr/a://c",
    "ftp://h?x=/de/", "http://example.com#/de/", "http://é.org/fr/é", "//a.net/", "http://net./", "http://a..net/x",
]


def plain_rule(url):
    head, _, rest = (url or "").partition("://")
    if "://" not in (url or ""):
        return "", "", None, None
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:][: min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]], default=len(rest))]
    fitting = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    fit = rule_of(host, path, RULES)
    for r in frame.select("url", host.alias("h"), path.alias("p"), fit["rule"].alias("r"), fit["verdict"].alias("v")).collect():
        assert (r["h"], r["p"], r["r"], r["v"]) == plain_rule(r["url"]), r["url"]
    assert frame.select(rule_of(host, path, ()).alias("r")).filter("r is not null").count() == 0


def test_trees_judge_what_no_rule_fits(spark):
    rng = random.Random(1)
    urls = [f"http://h{rng.randrange(99)}.net/x/{k}?a=1&b=2" for k in range(60)] + [f"https://w{k}.org/fr/{k}" for k in range(60)]
    urls += [f"http://h{k}.net/x/{k}?a=1&b=2".replace(".net", ".xyz") for k in range(10)] + [f"https://w{k}.org/de/{k}" for k in range(10)] + URLS
    pages = spark.createDataFrame([(k, u, "html", "x") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = judge(pages, trees=3, depth=2).collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(urls)))
    for r in got:
        host, path, rule, verdict = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert all(r["verdict"] == "allow" for r in got if 130 <= r["page_id"] < 140)
    assert {r["verdict"] for r in judge(pages.filter("page_id >= 130 and page_id < 140")).collect()} == {"allow"}
    assert judge(pages.limit(0)).count() == 0


def test_suffix_statistics_of_training_rows_leave_their_fold_out(spark):
    """Against a plain count; equal URLs (repeated rows) share a fold, a null URL has an empty host."""
    rng = random.Random(4)
    urls = [f"http://h{rng.randrange(9)}.{rng.choice(['net', 'org', 'xyz'])}/{rng.randrange(40)}" for _ in range(150)] + [None, None]
    rows = [(k, u, (u or "").partition("://")[2].partition("/")[0], rng.randrange(2)) for k, u in enumerate(urls)]
    labelled = spark.createDataFrame(rows, "id long, url string, host string, label int")
    fold = {r["id"]: r["f"] for r in labelled.select("id", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("f")).collect()}
    got = _with_suffixes(labelled, labelled, own_fold_out=True).collect()
    assert len(got) == len(rows)
    for r in got:
        others = [o for o in rows if fold[o[0]] != fold[r["id"]]]
        for name, depth in (("suffix", 1), ("domain", 2)):
            near = [o[3] for o in others if o[2].split(".")[-depth:] == r["host"].split(".")[-depth:]]
            assert abs(r[f"{name}_share"] - len(near) / len(others)) < 1e-12
            assert abs(r[f"{name}_rate"] - (sum(near) + 1) / (len(near) + 2)) < 1e-12


def test_held_out_urls_are_judged_like_their_rules(spark):
    urls = [f"http://h{k % 7}.net/x/{k}" for k in range(200)] + [f"https://w{k % 5}.org/fr/{k}" for k in range(200)]
    found = held_out_accuracy(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r["suffix"] for r in found} == {"net", "org"} and all(r["right"] == r["urls"] for r in found)


def test_every_label_counts_for_the_lexicon(spark, docs_of, monkeypatch):
    """Each word that three learnable texts of label 1 hold becomes a voter, in a table where label 1 is rare."""
    common = [a + b + "ne" for a in "abcdefghijklmnopqrstuvwxyz" for b in "aeiou"]
    rare = [f"q{a}{b}x" for a in "bcdfghjk" for b in "aeiou"]
    rng = random.Random(2)
    rows, labels, shown = [], [], {w: 0 for w in rare}
    for i in range(20_000):
        words = rng.sample(common, 6)
        toxic = int(i % 120 == 0)
        if toxic:
            words.append(rare[i // 120 % 40])
            shown[words[-1]] += not held(i, 5, 0)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic, ""))
    found = []
    monkeypatch.setattr(toxicity, "find_lexicon", lambda *a, real=toxicity.find_lexicon: found.append(real(*a)) or found[-1])
    toxicity_scores(docs_of(rows), spark.createDataFrame(labels, LABELS))
    telling = {w for w, n in shown.items() if n >= 3}
    assert len(telling) > 20 and telling <= set(found[0])
