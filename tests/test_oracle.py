"""Registered queries against their SQL twins. EMBERLOG_FULL=1 runs all of them."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registered
from emberlog.plans.registry import entries
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "search_histogram", "search", "match_glob", "match_percentile", "match_relevant", "facet_select", "related_events", "correlate_all",
    "field_facets", "rank_facets", "percentile_stops", "suggest", "complete_values", "export_jsonl", "explode_envelopes", "parse_event",
    "apply_parse_rules", "coalesce_events", "match_alerts", "extract_imports",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


def test_every_query_has_a_twin():
    """Of the log part; the training-data operators have tests of their own."""
    assert {name for name, (_, sql) in entries().items() if sql} == set(entries()) <= set(registered.queries())
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_queries_load_without_the_training_data_part():
    """With a package of that part missing, all other queries are still there."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    top = os.path.dirname(registered.__file__)
    said = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True, check=True).stdout.split()
    assert said == [str(len(entries()))] * 2


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()) if os.environ.get("EMBERLOG_FULL") else QUICK)
def test_query(spark, duck, name):
    df = registered.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(registered.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want and got
