"""The driver's contract, with or without the corpus operators."""

import sys

import __spark_entry__


def test_queries_and_their_sql():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 60 and all(map(callable, found.values()))
    assert "gallery_topk" in sql


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "rank", "image_name", "score"] and rows.count() > 0


def test_without_the_corpus_operators(monkeypatch):
    """The queries of the library stay when the subpackage and the pipeline are gone."""
    import importlib

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tallyvine.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tallyvine.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(__spark_entry__)
        assert alone.llm is None and alone.corpus_pipeline is None
        assert "gallery_topk" in alone.queries() and not any(n.startswith("op") or n == "pipeline" for n in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
