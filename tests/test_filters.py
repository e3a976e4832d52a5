import random

from alarmlens.operators.filters import drop_ignored, texts_with_pattern


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_long_list_against_the_rule(spark):
    """Patterns of one to nine letters, of which some are inside others; null and empty messages and patterns."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc%é") for _ in range(n))
    patterns = [word(rng.choice([2, 3, 5, 6, 7, 9])) for _ in range(150)] + [None, "", "%é%é%éx"]
    messages = [(i, word(rng.randint(0, 14))) for i in range(300)] + [(900, None), (901, ""), (902, "b"), (902, "b")]
    frame = spark.createDataFrame(messages, "seq bigint, message string")
    wanted = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = sorted(r.seq for r in drop_ignored(frame, wanted).collect())
    assert got == sorted(i for i, m in messages if not any(p and p in (m or "") for p in patterns))
    assert 20 < len(got) < 290


def test_one_letter_pattern_among_many(spark):
    frame = spark.createDataFrame([(1, "xyz"), (2, "abc")], "seq bigint, message string")
    wanted = spark.createDataFrame([("z",), *((f"long pattern {i}",) for i in range(100))], "pattern string")
    assert [r.seq for r in drop_ignored(frame, wanted).collect()] == [2]


def test_patterns_meet_texts_by_key(spark):
    frame = spark.createDataFrame([(i, f"message {i}") for i in range(50)], "seq bigint, message string")
    wanted = spark.createDataFrame([(f"essage {i}",) for i in range(100, 300)], "pattern string")
    plan = _plan(drop_ignored(frame, wanted)) + _plan(texts_with_pattern(frame.select("message"), wanted))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert drop_ignored(frame, wanted).count() == 50
