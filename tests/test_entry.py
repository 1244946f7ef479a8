"""Driver contract: entry runs on sf0.001, every query has a callable and its oracle."""

import __spark_entry__ as E

ROWS_ONLY: set[str] = set()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert {"care_site_id", "sub_cohort", "threshold", "n_events", "n_total", "rate", "analysis"} <= set(df.columns)
    assert df.count() > 0


def test_registry():
    q, o = E.queries(), E.oracle_sql()
    core = {n for n in q if n != "pipeline" and not n.startswith("op")}
    assert core - set(o) == ROWS_ONLY
    assert set(o) <= set(q)


def test_the_study_stands_where_the_optional_operators_cannot_be_imported():
    """With a library of theirs missing, the entry module imports and registers every other query."""
    import os
    import subprocess
    import sys
    code = ("import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); "
            "assert not E.HAS_LLM and len(q) > 70 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_stages_are_stored_once_and_scanned(spark):
    """The pipeline of the registered queries persists nothing: a second query of a stage scans its files."""
    before = spark._jsc.getPersistentRDDs().size()
    pipeline = E._pipeline(spark, E.SMOKE_DIR)
    first = pipeline.estimates("visit")
    assert pipeline.estimates("visit") is first and "FileScan parquet" in first._jdf.queryExecution().executedPlan().toString()
    assert spark._jsc.getPersistentRDDs().size() == before
