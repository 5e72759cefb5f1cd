import importlib.util

import __spark_entry__


def test_queries_without_the_text_operators(monkeypatch):
    """As if the folders of the text operators were deleted."""
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *more: None if name.startswith("weftgraph.llm") else found(name, *more))
    names = set(__spark_entry__.queries())
    assert "compare_summary" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
