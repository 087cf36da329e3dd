"""Every query with SQL gives DuckDB's rows; every other one runs."""

import os

import duckdb
import pandas as pd
import pytest

from fringelake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        cols = sorted(got.columns)
        assert sorted(want.columns) == cols
        tidy = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
        pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=1e-6, atol=2e-4)


def test_the_rest_stands_without_the_corpus_operators():
    import ast
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            names = [n for node in ast.walk(ast.parse(path.read_text())) if isinstance(node, (ast.Import, ast.ImportFrom)) for n in [getattr(node, "module", None) or "", *(a.name for a in node.names)]]
            assert not any("llm" in n for n in names), path
