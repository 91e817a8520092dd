"""Each stage on its own input, and on awkward rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bidlens.llm import mixing, neardup, passages, toxicity

from .test_operators import ODD, brute_components, check_packing, passage, word_sets

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "toxicity":
            low = toxicity.score(docs, toxicity.learn(docs, labels)).where("score < 0.7").select("doc_id").collect()
            assert set(ids) == {r["doc_id"] for r in low}
        if name == "minhash_near_dedup":
            texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
            assert set(ids) == {d for d, c in brute_components(word_sets(texts, 5)).items() if c == d}
            again = neardup.near_duplicates(out, size=5)
            assert again.where("doc_id <> component_id").count() == 0
        if name == "substring_dedup":
            assert out.count() == docs.count() and out.where("n_chars <> length(text)").count() == 0
            own = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()}
            assert {r["doc_id"]: r["text"] for r in out.collect()} == own
        if name == "mix_sources":
            assert ids == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs).where("copies > 0").collect()})
        if name == "best_fit_packing":
            check_packing(out.collect(), [(r["doc_id"], r["text"] or "") for r in docs.collect()])
        sizes.append(out.count())
        docs = out
    assert 0 < sizes[1] < sizes[0] <= 1000 and sizes[2] == sizes[1] < sizes[4]


@pytest.fixture
def odd(spark):
    """Null, blank, long, repeated and tied rows, and columns that bear the operators' own names."""
    p = passage(9, 60)
    rows = [(d, t, None, s, 5, i) for i, (d, t, s) in enumerate(ODD)] + [(20 + i, f"{passage(40 + i, 30)} {p}", "en", "a", 7, 50 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, line long")
    for c in ("score", "predicted", "n_removed", "n_blocks", "row", "copies", "rank", "label", "node", "blocks", "tag", "key", "hash", "place"):
        df = df.withColumn(c, F.concat(F.lit(c), F.col("line").cast("string")))
    return df


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_stages_on_odd_rows(spark, odd, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd, SF)
    assert out.columns == odd.columns
    got, before = out.collect(), {r["line"]: r for r in odd.collect()}
    for r in got:  # a row's own columns stay with it
        was = before[r["line"]]
        assert all(r[c] == was[c] for c in odd.columns if c not in ("text", "n_chars"))
        assert r["text"] == was["text"] or (name == "substring_dedup" and r["n_chars"] == len(r["text"]) < len(was["text"]))
    lines = Counter(r["line"] for r in got)
    if name == "toxicity":
        assert lines == Counter(list(before))
    if name == "minhash_near_dedup":
        assert lines[0] and lines[1] and lines[2] and lines[5] and not lines[7] and lines[8] == lines[9] == 1 and lines[12] and not lines[13] and not lines[4]
    if name == "substring_dedup":
        assert set(lines) == {n for n, r in before.items() if r["doc_id"] is not None}
        cut = {r["line"] for r in got if r["text"] != before[r["line"]]["text"]}
        assert {7, 51, 52, 53} <= cut and not cut & {0, 1, 2, 3, 4, 5, 8, 9, 50}
    if name == "mix_sources":
        assert set(lines.values()) <= {1, 2} and 10 not in lines
        words = sum(n * len((before[k]["text"] or "").split()) for k, n in lines.items())
        assert words > 0


def test_packing_stage_on_odd_rows(spark, odd):
    check_packing(corpus_pipeline.pack_sequences(spark, odd, SF).collect(), [(r["doc_id"], r["text"] or "") for r in odd.where("doc_id is not null").collect()])


def test_stages_on_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_nothing_but_results_stays(spark, tmp_path):
    import pathlib

    from bidlens.llm.common import shared_dir

    before = set(pathlib.Path(shared_dir(spark)).iterdir())
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    left = set(pathlib.Path(shared_dir(spark)).iterdir()) - before
    assert [p.name.split("-")[0] for p in left] == ["pipeline"]
