import importlib
import sys

import __spark_entry__


def test_every_oracle_has_its_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(f) for f in queries.values())


def test_the_core_stands_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lodestrata.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lodestrata.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    entry = importlib.import_module("__spark_entry__")
    assert "p1_found" in entry.queries() and "p6_ids" not in entry.queries()
