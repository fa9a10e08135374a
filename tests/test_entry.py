"""The driver's contract."""

import inspect

import __spark_entry__ as entry


def test_queries_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert all(list(inspect.signature(q).parameters) == ["spark", "base"] for q in queries.values())
    assert {"p4_found", "p6_found", "p7_found"} <= set(queries)


def test_core_does_not_use_the_text_subpackage():
    import re
    from pathlib import Path

    for path in (Path(entry.ROOT) / "tsumugi").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"tsumugi\.llm|from \.llm", path.read_text()), path
