"""Every stage of the pipeline on empty tables and on columns whose names clash with helpers'."""

import pytest

import corpus_pipeline as p

CLASH = ["gone_id", "gone_sha", "gone_n", "gone_pick", "row", "pick", "stands", "key", "cid", "n", "norm", "kept", "c"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)
TEXT = "the quick brown fox jumps over the lazy dog while many other animals look on from the hedge "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "an item that none of these documents holds at any place whatever it may be")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}{i}" for c in CLASH]) for i, t in rows], SCHEMA)


def test_clashing_columns_are_carried_along(spark, folder):
    docs = _rows(spark, [(1, TEXT * 3), (2, TEXT * 3 + " "), (3, TEXT * 3 + "end"), (4, "short text"), (4, "short  text"), (5, None), (6, None), (None, "no id")])
    left = {"exact_dedup": [None, 2, 3, 4, 5], "near_dedup": [None, 2, 4, 5], "decontaminate": [None, 2, 4, 5]}
    for name, stage in p.STAGES[1:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert sorted([r.doc_id for r in rows], key=str) == sorted(left[name], key=str)
        assert all(r.gone_id == f"gone_id{r.doc_id}" for r in rows)
        docs = p.written(out, "test")
    assert p.STAGES[-1][1](spark, docs, folder).count() == 4


def test_stages_on_an_empty_table(spark, folder):
    docs = _rows(spark, [])
    for name, stage in p.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_language_stage_with_clashing_columns(spark, folder):
    docs = _rows(spark, [(i, TEXT) for i in range(30)] + [(40, None), (41, "12 34"), (42, "")])
    out = p.STAGES[0][1](spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(30))
