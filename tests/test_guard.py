"""The SQL audit and the guarded run."""

import pytest

from seaflow.operators.querylog import BLOCKED_WORDS, MAX_ROWS, audit, guarded_query
from seaflow.sources.fixtures import freight


@pytest.fixture(scope="module")
def t(spark):
    return freight(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def check(spark):
    def one(sql):
        return audit(spark.createDataFrame([(sql,)], "sql string")).first()

    return one


@pytest.mark.parametrize("word", BLOCKED_WORDS.split("|"))
@pytest.mark.parametrize("form", ["{} port", "{} something (a) of container", "  {}\tinto route_leg"])
def test_forbidden(check, word, form):
    row = check(form.format(word.lower()))
    assert not row.is_valid and row.sanitized_sql == ""
    assert any("Forbidden keyword" in e for e in row.errors)
    assert any("SELECT or WITH" in e for e in row.errors)


@pytest.mark.parametrize(
    "sql, word",
    [
        ("select eta from voyage_stop --", "comment"),
        ("select eta */ from voyage_stop", "comment"),
        ("SELECT 'a''b' ; SELECT 2", "semicolon"),
        ("describe route", "SELECT or WITH"),
        (" \n", "empty"),
        (None, "empty"),
        ("select eta from voyage_stop order by", "syntax"),
        ("select eta from voyage_stop" + " " * 40 + "where   ", "syntax"),
        ("select * from port p join zone z on z.id = p.port_id", "'ZONE'"),
    ],
)
def test_rejected_with_reason(check, sql, word):
    row = check(sql)
    assert not row.is_valid and any(word in e for e in row.errors)


@pytest.mark.parametrize(
    "sql",
    [
        "select route_name from route",
        "WITH legs AS (SELECT route_id, count(*) AS n FROM route_leg GROUP BY route_id) SELECT max(n) FROM legs",
        "SELECT c.company_name, s.bl_number FROM customer c JOIN shipment s USING (customer_id)",
        "SELECT sum(value_usd) FROM cargo_item",
        "SELECT stop_id, dense_rank() OVER (PARTITION BY port_id ORDER BY eta) FROM voyage_stop",
        "SELECT 1 FROM container WHERE EXISTS (SELECT 1 FROM shipment WHERE status <> ';')",
        "SELECT upper(un_locode) || ';' FROM port ORDER BY 1",
        "SELECT strftime('%Y', departure_date) FROM voyage",
        "SELECT 5 / 2",
    ],
)
def test_accepted(t, check, sql):
    row = check(sql)
    assert row.is_valid and row.errors == [] and isinstance(row.warnings, list)
    outcome = guarded_query(t, sql)
    assert outcome.is_valid and outcome.result.limit(1).count() == 1


def test_limits(check):
    row = check("SELECT vessel_id FROM VESSEL;")
    assert row.sanitized_sql == f"SELECT vessel_id FROM VESSEL\nLIMIT {MAX_ROWS}"
    assert row.warnings == ["LIMIT 1,000 appended automatically (no LIMIT clause found)."]
    kept = check("SELECT vessel_id FROM VESSEL LIMIT 5")
    assert kept.sanitized_sql.endswith("LIMIT 5") and kept.warnings == []
    for given, shown in (("10000", "10,000"), ("0001001", "1,001"), ("123456789012345678901", "123,456,789,012,345,678,901")):
        clamped = check(f"SELECT vessel_id FROM VESSEL LIMIT {given}")
        assert clamped.sanitized_sql.endswith("LIMIT 1000")
        assert clamped.warnings == [f"LIMIT clamped from {shown} to 1,000 (maximum rows allowed per query)."]


def test_all_security_problems_are_reported(check):
    row = check("DROP TABLE x; -- y")
    assert len(row.errors) == 4


def test_guard_finds_what_only_analysis_can(t):
    outcome = guarded_query(t, "SELECT no_such_column FROM VESSEL")
    assert outcome.result is None and "syntax / planning error" in outcome.errors[0]
    assert not guarded_query(t, "SELECT FROM WHERE x").is_valid


@pytest.fixture(scope="module")
def foreign(spark):
    spark.range(3).createOrReplaceGlobalTempView("hidden")
    yield
    spark.catalog.dropGlobalTempView("hidden")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM `global_temp`.`hidden`",
        "SELECT h.* FROM port, global_temp.hidden h",
        "SELECT * FROM port p, spark_catalog.default.payroll q",
        "SELECT port_name, (SELECT max(id) FROM `global_temp`.hidden) FROM port",
        "SELECT port_name FROM port WHERE port_id IN (SELECT id FROM `global_temp`.hidden)",
        "WITH x AS (SELECT * FROM `global_temp`.hidden) SELECT * FROM x",
        "SELECT * FROM port, range(5)",
        "SELECT * FROM port, LATERAL (SELECT * FROM `global_temp`.hidden)",
        "SELECT input_file_name() FROM port",
        "SELECT current_catalog() FROM port",
        "SELECT spark_catalog.default.f(1) FROM port",
    ],
)
def test_guard_sees_the_whole_plan(t, foreign, sql):
    outcome = guarded_query(t, sql)
    assert outcome.result is None and outcome.errors


def test_guard_reports_what_ran(t):
    text = "SELECT count(*) AS n FROM (SELECT stop_id FROM voyage_stop LIMIT 5000) x LIMIT 10"
    outcome = guarded_query(t, text)
    assert outcome.result.collect() == t.run_query(outcome.sql).collect()
    stops = t.voyage_stop.count()
    assert outcome.result.first().n == min(5000, stops) > MAX_ROWS


def test_guard_caps_the_outer_query(t):
    outcome = guarded_query(t, "SELECT * FROM (SELECT stop_id FROM VOYAGE_STOP LIMIT 900) x CROSS JOIN PORT", max_rows=50)
    assert outcome.result.count() == 50


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT reflect('java.lang.System', 'getenv') FROM PORT",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`",
        "SELECT * FROM PORT, parquet.`/root/testdata/sf0.001/part.parquet`",
    ],
)
def test_guard_keeps_to_the_tables(t, sql):
    assert not guarded_query(t, sql).is_valid


@pytest.fixture(scope="module")
def payroll(t):
    """A table of someone else that a session can name without a catalog."""
    session = t.sql_session()
    session.sql("SELECT 41 AS x").createOrReplaceTempView("payroll")
    yield
    session.catalog.dropTempView("payroll")


@pytest.mark.parametrize(
    "sql",
    [
        "WITH payroll AS (SELECT * FROM payroll) SELECT * FROM payroll",
        "SELECT * FROM (WITH payroll AS (SELECT 1 AS x) SELECT * FROM payroll) a JOIN payroll b ON 1=1",
        "WITH a AS (SELECT * FROM payroll), payroll AS (SELECT 1 AS x) SELECT * FROM a",
        "WITH a AS (WITH payroll AS (SELECT 1 AS x) SELECT * FROM payroll) SELECT a.x, p.x FROM a, payroll p",
        "SELECT (WITH payroll AS (SELECT 1 AS x) SELECT max(x) FROM payroll) AS n FROM payroll",
        "SELECT port_id FROM port WHERE port_id IN (WITH payroll AS (SELECT 1 AS x) SELECT x FROM payroll) "
        "AND EXISTS (SELECT 1 FROM payroll)",
        "WITH a AS (SELECT 1 AS x) SELECT * FROM a UNION ALL (WITH b AS (SELECT 2 AS x) SELECT * FROM b) UNION ALL SELECT * FROM b",
        "SELECT * FROM port p, LATERAL (SELECT x FROM payroll) q",
    ],
)
def test_guard_knows_where_a_named_query_can_be_seen(t, payroll, sql):
    outcome = guarded_query(t, sql)
    assert outcome.result is None and any("Unknown table" in e for e in outcome.errors), outcome


@pytest.mark.parametrize(
    "sql, n",
    [
        ("WITH payroll AS (SELECT 7 AS x) SELECT x FROM PAYROLL", 7),
        ("WITH a AS (SELECT 3 AS x), b AS (SELECT x + 1 AS x FROM a) SELECT b.x FROM b JOIN a ON a.x < b.x", 4),
        ("WITH port AS (SELECT 5 AS x) SELECT x FROM port", 5),
        ("WITH a AS (SELECT 1 AS x) SELECT (SELECT max(x) FROM a) + (SELECT count(*) FROM a WHERE x IN (SELECT x FROM a)) AS x", 2),
        ("WITH a AS (SELECT 2 AS x) SELECT * FROM (WITH b AS (SELECT x * 4 AS x FROM a) SELECT b.x FROM b, a) y", 8),
        ("WITH a AS (SELECT 1 AS x) SELECT * FROM (WITH a AS (SELECT x + 8 AS x FROM a) SELECT x FROM a) y", 9),
        ("WITH RECURSIVE up AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM up WHERE x < 6) SELECT max(x) AS x FROM up", 6),
    ],
)
def test_guard_lets_named_queries_pass_in_their_scope(t, payroll, sql, n):
    outcome = guarded_query(t, sql)
    assert outcome.is_valid, outcome.errors
    assert outcome.result.first()[0] == n


def test_a_recursive_name_is_never_a_table(t, payroll):
    outcome = guarded_query(t, "WITH RECURSIVE payroll AS (SELECT * FROM payroll) SELECT * FROM payroll")
    assert outcome.result is None
