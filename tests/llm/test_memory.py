"""What travels to Python and stays there must be small: texts once, in small batches; tables of powers."""

import numpy as np

from scour.llm import op02_langid, textkit
from scour.llm.common import small_batches
from scour.llm.op08_decontam import decontaminate

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _to_python(df) -> list[str]:
    """Columns that the first Python stage is given."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() != "MapInArrow":
        node = node.children().apply(0)
    out = node.children().apply(0).output()
    return [out.apply(i).name() for i in range(out.size())]


def test_a_carried_text_travels_once(spark):
    docs = spark.createDataFrame([(1, "x", "one two three four five six"), (2, "x", None), (None, "y", "other words")], "doc_id bigint, lang string, text string")
    bench = spark.createDataFrame([(7, "two three four five six")], "item_id bigint, text string")
    found = decontaminate(docs, bench, carry=True)
    assert "text" not in _to_python(found) and "row" in _to_python(found)
    assert {r.doc_id: (r.contaminated, r["items"], r.row.text, r.row.lang) for r in found.collect()} == {
        1: (True, [7], "one two three four five six", "x"), 2: (False, [], None, "x"), None: (False, [], "other words", "y")}
    assert sorted((r.doc_id or 0, r.contaminated) for r in decontaminate(docs, bench).collect()) == [(0, False), (1, True), (2, False)]
    named = op02_langid.identify(docs, carry=True)
    assert "text" not in _to_python(named)
    plain = {r.doc_id: tuple(r)[:5] for r in op02_langid.identify(docs).collect()}
    assert {r.doc_id: tuple(r)[:5] for r in named.collect()} == plain


def test_pipeline_asks_for_small_batches_and_keeps_a_set_limit(spark):
    spark.conf.unset(BATCH)
    small_batches(spark)
    assert spark.conf.get(BATCH) == "4m"
    spark.conf.set(BATCH, "32m")
    small_batches(spark)
    assert spark.conf.get(BATCH) == "32m"
    spark.conf.unset(BATCH)


def test_powers_of_any_number_keep_a_small_table():
    for n in (0, 1, 2, 4095, 4096, 4097, 100_000):
        want = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        want[:1] = 1
        assert (textkit.powers(n, 0x9E3779B97F4A7C15) == np.cumprod(want, dtype=np.uint64)).all()
    textkit.powers(1 << 20, 3)
    assert textkit._kept(3).nbytes <= 1 << 16
