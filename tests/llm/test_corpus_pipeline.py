import importlib

import pytest

from alarmlens.llm import language_id
from alarmlens.llm.bpe import Codec
from tests.llm.plain import linked, simhash
from tests.llm.test_decontaminate import plain

pytest.importorskip("public_tokenizers")
corpus_pipeline = importlib.import_module("corpus_pipeline")


def test_stages_equal_a_plain_run(spark, tmp_path, monkeypatch):
    """Every stage on all its predecessor kept. Language: 'und' exactly where no letter stands."""
    monkeypatch.setattr(language_id, "train", lambda examples, steps=0, real=language_id.train: real(examples, 20))
    base = [f"alpha{k} beta gamma{k % 3} delta epsilon zeta{k} eta theta iota kappa lambda{k} mu nu xi" for k in range(12)]
    texts = [*base, base[3], base[3], base[5] + " ", base[7].replace("xi", "XI"), None, "", "1 2 3 ?!", "été"]
    texts += [base[9] + " and " + "this passage of ten words stands in the benchmark itself"]
    rows = [(i, t, ("en", "fr")[i % 2], "s", None) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]
    items = [(1, "zzz"), (2, "THIS passage of ten words stands in the benchmark itself")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t, *_ in rows if any(map(str.isalpha, t or ""))]
    keep = {}
    for i, t in kept:
        keep[t] = max(i, keep.get(t, -1))
    kept = sorted((i, t) for t, i in keep.items())
    groups = linked({i: simhash(t) for i, t in kept})
    kept = [(i, t) for i, t in kept if groups[i] == i]
    clean = {eval(r)[0] for r in plain(kept, items) if not eval(r)[5]}
    kept = [(i, t) for i, t in kept if i in clean]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == kept
    coder = Codec(corpus_pipeline.vocabulary())
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == [(i, len(coder.encode(t))) for i, t in kept]


def test_stages_of_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_or_have_none_are_decided_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(language_id, "train", lambda examples, steps=0, real=language_id.train: real(examples, 5))
    passage = "this passage of ten words stands in the benchmark itself"
    text = [" ".join(f"{w}{k}" for k in range(9)) for w in ("alpha", "beta", "gamma", "delta")]
    letterless, leaked = ["1 2 3", "", None, "?!"], [f"{t} {passage}" for t in text]
    near = {t: t.upper().title() for t in text}  # other text, same fingerprint
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], docs)
    frame([(1, text[0]), (2, text[1])]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda stage, rows: sorted(((r["doc_id"] or -1, r["text"]) for r in stage(spark, frame(rows), str(tmp_path)).collect()), key=str)

    for i, shown in ((None, -1), (7, 7)):
        rows = [(i, t) for t in text]
        whole = sorted(((shown, t) for t in text), key=str)
        assert run(corpus_pipeline.language_stage, rows + [(i, t) for t in letterless]) == whole
        assert run(corpus_pipeline.benchmark_stage, rows + [(i, t) for t in leaked]) == whole
        got = run(corpus_pipeline.near_stage, rows + rows[:1] + [(i, near[t]) for t in text])
        assert len(got) == 4 and {t.lower() for _, t in got} == set(text)
    mixed = run(corpus_pipeline.near_stage, [(None, text[0]), (9, near[text[0]]), (9, text[1]), (None, near[text[1]]), (None, near[text[2]])])
    assert mixed == sorted([(9, near[text[0]]), (9, text[1]), (-1, near[text[2]])], key=str)
