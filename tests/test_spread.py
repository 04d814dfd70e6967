"""Split windows against plain ones, with a key that holds a third of all rows and many ties."""

import pytest

from seaflow.functions import spread
from seaflow.operators import trends, windows
from seaflow.sources.fixtures import freight

SPLITS = [1, 40, 700, 10**9]


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows: key 0 has a third of them, the rest is spread over 60 keys; positions are unique per key."""
    return spark.range(3000).selectExpr(
        "id",
        "if(id % 3 = 0, 0L, id % 60 + 1) as k",
        "id * 7919 % 3001 as pos",
        "cast(id * 31 % 97 as double) / 4 as v",
        "cast(id * 13 % 1009 as decimal(18,2)) as amount",
    )


def same(left, right):
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


@pytest.mark.parametrize("split_rows", SPLITS)
@pytest.mark.parametrize("keys", [["k"], []])
def test_numbered(rows, split_rows, keys):
    over = f"over ({'partition by k ' if keys else ''}order by pos)"
    split = spread.numbered(
        rows, keys, ["pos"], {"a": "floor(pos / 500)", "b": "floor(pos / 20)"}, "n", split_rows=split_rows
    )
    same(split.select("id", "n"), rows.selectExpr("id", f"cast(row_number() {over} as bigint) as n"))


@pytest.mark.parametrize("split_rows", SPLITS)
@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_ranked(rows, split_rows, dense, keys):
    over = f"over ({'partition by k ' if keys else ''}order by v desc)"
    split = spread.ranked(rows, keys, "v", {"a": "-floor(v)"}, "r", dense=dense, split_rows=split_rows)
    plain = f"cast({'dense_rank' if dense else 'rank'}() {over} as bigint) as r"
    same(split.select("id", "r"), rows.selectExpr("id", plain))


@pytest.mark.parametrize("split_rows", SPLITS)
@pytest.mark.parametrize("keys", [["k"], []])
def test_running(rows, split_rows, keys):
    over = (
        f"over ({'partition by k ' if keys else ''}order by amount desc, id "
        "rows between unbounded preceding and current row)"
    )
    split = spread.running(
        rows,
        keys,
        ["amount desc", "id"],
        {"a": "-floor(amount / 100)", "b": "-amount", "c": "shiftright(id, 4)"},
        "amount",
        "s",
        split_rows=split_rows,
    )
    same(
        split.selectExpr("id", "cast(s as double) as s"),
        rows.selectExpr("id", f"cast(sum(amount) {over} as double) as s"),
    )


@pytest.mark.parametrize("split_rows", SPLITS)
@pytest.mark.parametrize("following", [False, True])
def test_neighbour(rows, split_rows, following):
    move = "lead" if following else "lag"
    split = spread.neighbour(
        rows, ["k"], ["pos"], {"a": "floor(pos / 50)"}, ["id", "v"], "other", following=following, split_rows=split_rows
    )
    plain = rows.selectExpr("id", f"{move}(id) over (partition by k order by pos) as other")
    same(split.selectExpr("id", "other.id as other"), plain)


@pytest.mark.parametrize("split_rows", SPLITS)
@pytest.mark.parametrize("keys", [["k"], []])
def test_cut_by_quantiles(rows, split_rows, keys):
    """Values within one unit, negative ones, and one that a fifth of all rows have."""
    close = rows.selectExpr("*", "if(id % 5 = 0, 0.5e0, (pos - 1500) / 3001.0e0) as near", "timestamp_ntz'2025-01-01' + make_interval(0, 0, 0, 0, 0, 0, pos % 7) as at")
    partition = f"partition by {', '.join(keys)} " if keys else ""
    number = spread.numbered(close, keys, ["near", "at desc", "id"], None, "n", split_rows=split_rows)
    same(number.select("id", "n"), close.selectExpr("id", f"cast(row_number() over ({partition}order by near, at desc, id) as bigint) as n"))
    for dense in (False, True):
        rank = spread.ranked(close, keys, "near", None, "r", dense=dense, split_rows=split_rows)
        plain = f"cast({'dense_rank' if dense else 'rank'}() over ({partition}order by near desc) as bigint) as r"
        same(rank.select("id", "r"), close.selectExpr("id", plain))
    total = spread.running(close, keys, ["amount desc", "id"], None, "amount", "s", split_rows=split_rows)
    plain = f"sum(amount) over ({partition}order by amount desc, id rows between unbounded preceding and current row)"
    same(total.selectExpr("id", "cast(s as double) as s"), close.selectExpr("id", f"cast({plain} as double) as s"))


@pytest.mark.parametrize("values", ["pos / 1e7", "pos * 1e12", "if(id % 5 < 3, 0.5e0, pos / 1e7)", "7e0"])
def test_cells_are_bounded_at_any_scale(rows, values):
    df = rows.selectExpr("id", "k", f"{values} as v")
    levels = spread.quantile_levels(df, ["k"], ["v", "id"], 100)
    cells = df.filter("k = 0").selectExpr("*", *[f"{e} as {n}" for n, e in levels.items()]).groupBy(*levels)
    assert 5 <= cells.count().count()
    assert cells.count().selectExpr("max(count) as n").first()["n"] <= 110  # quantiles are approximate


def test_small_groups_are_not_cut(rows):
    assert spread.quantile_levels(rows, ["k"], ["v"], 1000) == {}
    plan = spread.numbered(rows, ["k"], ["pos"], None, "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 1
    assert spread.quantile_levels(rows.limit(0), [], ["v"]) == {}


@pytest.mark.parametrize(
    "operator",
    [
        windows.delay_rank_at_port,
        windows.revenue_rank_in_country,
        windows.booking_sequence,
        windows.delay_change,
        windows.next_leg,
        trends.value_concentration,
        trends.delay_by_vessel,
    ],
)
def test_analyses_do_not_depend_on_the_split(spark, operator):
    t = freight(spark, "/root/testdata/sf0.001")
    same(operator(t, split_rows=2), operator(t))


def test_small_groups_cost_no_join_with_levels(rows):
    """Nor does a number that isn't read cost a shuffle."""
    numbered = spread.numbered(rows, ["k"], ["pos"], {"a": "floor(pos / 500)"}, "n", split_rows=1000)
    moved = spread.neighbour(rows, ["k"], ["pos"], {"a": "floor(pos / 50)"}, ["id"], "other", split_rows=1000)
    for df in (numbered, moved):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Window") == 1
    assert "Exchange" not in numbered.select("id")._jdf.queryExecution().executedPlan().toString()
