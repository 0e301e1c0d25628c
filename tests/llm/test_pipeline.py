"""The pipeline's stages on a small corpus, and the entries of the subpackage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from findra.llm import registry
from test_llm_operators import docs_of, near_copies, prose


def test_stages(spark, tmp_path):
    rows = [(i, prose(lang, i, 80), lang, f"s{i % 3}") for i, lang in enumerate(("en", "fr", "de", "es") * 30)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "s1") for i in range(10)] + [(300, "12 34", "en", "s0"), (301, None, None, None)]
    leaked = " ".join(f"b{i}" for i in range(12))
    rows.append((302, prose("en", 302, 30) + " " + leaked, "en", "s2"))
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leaked)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"] for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now = now.cache()
        after = {r["doc_id"] for r in now.collect()}
        gone, left = left - after, after
        if name == "language ID":
            assert gone == {300, 301}
        if name == "n-gram Jaccard join":
            assert gone == set(range(200, 210))
        if name == "benchmark decontamination":
            assert gone == {302}
    assert 0 < len(left) < 120
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = docs_of(spark, [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows_and_names(spark, tmp_path):
    """Nulls in every column, repeated rows, a long text, and columns named as operators name theirs."""
    names = ["judged_lang", "hit_id", "mixer_u", "row", "linked"]
    rows = [(i, prose(lang, i, 60), lang, f"s{i % 2}") for i, lang in enumerate(("en", "fr", "de", "es") * 10)]
    rows += [(None, prose("en", 90), None, None), (50, None, None, None), (51, "", "en", "s1"), (52, prose("de", 52, 20_000), "de", "s0"), (1, prose("fr", 1, 60), "fr", "s1")]
    docs = docs_of(spark, rows).drop("items", "row", "tokens")
    for name in names:
        docs = docs.withColumn(name, F.lit("own"))
    spark.createDataFrame([(None, None), (1, ""), (2, "no such words here at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns, name
        assert now.where(" AND ".join(f"{n} = 'own'" for n in names)).count() == now.count(), name
        if name == "n-gram Jaccard join":
            assert now.where("doc_id = 1").count() == 1 and now.where("doc_id IS NULL").count() == 1
    ids = [r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()]
    assert len(ids) == now.count() and not {50, 51} & set(ids)


def test_token_files_take_less_memory_than_alone(spark, monkeypatch):
    """The stage runs beside what earlier ones left in the executors; its ids are those of the operator alone."""
    plain, bounds = corpus_pipeline.token_output.token_output, {}

    def recorded(*args, **more):
        bounds.update(more)
        return plain(*args, **more)

    monkeypatch.setattr(corpus_pipeline.token_output, "token_output", recorded)
    docs = docs_of(spark, [(i, prose("en", i, 30), "en", "s") for i in range(20)])
    got = corpus_pipeline.token_files(spark, docs, "").collect()
    assert bounds["cache"] < corpus_pipeline.token_output.CACHE_CHUNKS and bounds["batch_chars"] < corpus_pipeline.token_output.BATCH_CHARS
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain(spark, docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).collect()))


def test_every_operator_has_its_query():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


def test_fixture_has_groups():
    assert len({t for _, t in near_copies(50, 1)}) > 5 and np.isfinite(1)
