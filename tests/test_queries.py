"""Every registered query of the library against DuckDB. Gold, its labelled windows and features are stored once and shared."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from headwise.plans import catalog
from headwise.sources.staging import stage

NAMES = list(catalog.QUERIES)
SHARED = {"_gold": lambda f: stage(f, "shared-gold"), "_labelled": lambda f: f, "_features": lambda f: f}


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def shared_inputs():
    """The inputs many queries start from are built by the first query that asks and kept for the others. The query that
    is Gold itself (``gold_final_table``) builds its own."""
    plain = {name: getattr(catalog, name) for name in SHARED}
    kept = {}

    def once(name):
        def get(spark, sf):
            if (name, sf) not in kept:
                kept[name, sf] = SHARED[name](plain[name](spark, sf))
            return kept[name, sf]

        return get

    for name in SHARED:
        setattr(catalog, name, once(name))
    yield
    for name, function in plain.items():
        setattr(catalog, name, function)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, sf_dir, shared_inputs, name):
    assert compare(spark, db, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    frame = entry.entry(spark)
    assert len(frame.columns) == 16
    assert frame.count() > 0


def test_session_zone_does_not_change_results(spark, db, sf_dir):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for name in ("normalize_time", "gold_final_table", "line_datehour_metrics", "temporal_split"):
            reason = compare(spark, db, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
            assert reason is None, f"{name}: {reason}"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
