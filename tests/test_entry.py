"""The driver's entry, and that the core stands without the optional subpackage."""

import ast
import glob
import os

import pytest

import __spark_entry__ as entry
from leafspan.session import package_root

DATA = "/root/testdata/sf0.001"


def test_core_does_not_import_the_optional_subpackage():
    for path in glob.glob(f"{package_root()}/**/*.py", recursive=True):
        if os.sep + "llm" + os.sep in path:
            continue
        for node in ast.walk(ast.parse(open(path).read())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_flagship_and_sql(spark):
    import duckdb

    assert entry.entry(spark).columns == ["page_id", "node_id", "text"]
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    for name in ("q_nodes", "q_chain_nav_li_a", "q_p_text_trim_ends", "q_size_hint", "q_print_document", "q_class_inputs"):
        df = entry.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        r = c.execute(entry.oracle_sql()[name])
        at = [d[0] for d in r.description]
        expected = sorted((tuple(row[at.index(k)] for k in cols) for row in r.fetchall()), key=repr)
        assert sorted((tuple(row[k] for k in cols) for row in df.collect()), key=repr) == expected, name
