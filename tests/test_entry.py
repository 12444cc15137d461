"""The driver's contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 3 and sum(r.n_epochs for r in rows) == 5


@pytest.mark.parametrize(("sf", "flagship", "either", "compat"), [("sf0.001", 3, 16, 3), ("sf0.01", 21, 162, 5)])
def test_golden_counts(spark, sf, flagship, either, compat):
    from chronofind.fixtures import event_catalog
    from chronofind.operators.timeseries import matching_rows
    from chronofind.queries.reference import FLAGSHIP, chain, metric, request, value

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no test tables")
    c = event_catalog(spark, f"/root/testdata/{sf}")
    canary = request(chain("OR", metric("click"), value("canary", "y")))
    assert matching_rows(c, request(FLAGSHIP)).select("shard", "series_id").distinct().count() == flagship
    assert matching_rows(c, canary, compat=False).count() == either and matching_rows(c, canary).count() == compat


@pytest.mark.parametrize("missing", ["ahocorasick", "chronofind.llm"])
def test_all_else_works_without_the_optional_part(missing):
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('p8') for n in e.queries()), 'flagship_timeseries' in e.oracle_sql())"
    said = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__))).stdout.split()
    assert int(said[0]) > 60 and said[1:] == ["False", "True"]
