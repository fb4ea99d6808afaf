"""Registered queries next to their SQL, and what the package must not touch."""

import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.llm.conftest import SF
from tidemark.llm.queries import ORACLES, QUERIES
from tools.compare import TABLES, rows_of

ROOT = Path(__file__).parents[2]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_every_operator_and_the_pipeline_are_registered():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "pack"]


def test_nothing_else_imports_the_package():
    others = [p for p in ROOT.rglob("*.py") if not {"llm", ".git"} & set(p.parts) and p.name not in ("__spark_entry__.py", "corpus_pipeline.py")]
    assert not [p for p in others if re.search(r"tidemark\.llm|corpus_pipeline", p.read_text())]
