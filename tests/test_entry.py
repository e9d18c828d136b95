import importlib
import os
import re
import sys
from pathlib import Path

import pytest

import __spark_entry__
from lodestack import queries as core

DATA = "/root/testdata/sf0.001"


def test_sql_is_for_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_llm_folder(monkeypatch):
    root = Path(__spark_entry__.__file__).parent / "lodestack"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
    for name in [n for n in sys.modules if n.startswith("lodestack.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lodestack.llm", None)
    alone = importlib.reload(__spark_entry__)
    try:
        assert alone.queries() and not any(re.match(r"p\d+_", n) for n in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(__spark_entry__.oracle_sql()) & set(core.queries())))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = __spark_entry__.queries()[name](spark, DATA)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    at = [c[0] for c in cur.description]
    rounded = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert rounded([tuple(r) for r in df.select(*at).collect()]) == rounded(cur.fetchall())
