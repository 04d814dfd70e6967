"""Ranking, numbering, running totals and neighbour access that survive very large groups.

A plain window puts a whole group into one task. Here a group of more than ``split_rows`` rows is first cut along
its own order into cells (a day, a block of sequence numbers, one distinct value ...). The window then runs per
cell, and what lies before a cell is added from totals per cell, which are aggregated map-side and hold few rows.
Smaller groups stay in one piece. A small job looks for large groups when the function is called; if there are none, the
plan is the plain window, whose column costs nothing where it isn't read. Every cut is a function of
the row itself: a recomputed partition always lands in the same cell.

Rows whose key is NULL are a group like others; order columns must not be NULL. Expressions are SQL texts. ``levels`` maps a
name to an expression that never decreases along the order; each level refines the ones before it. ``sizes`` may
give the group sizes (keys and ``_rows``), or an upper bound of them, where a smaller table knows them.

Without ``levels`` the cells are ranges between quantiles of the order columns (``quantile_levels``), whatever the
scale of their values: if there are large groups, another job finds the boundaries, which are then constants of the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import totals

SPLIT_ROWS = 1_000_000
MOST_CELLS = 16_384  # ranges of one order column; a constant of the plan holds a boundary each
_BLOCK_BITS = 20
_BUCKETS = 65_536  # counts of rows by a hash of the keys, before any group is counted


def block(number: str) -> str:
    """Blocks of about a million consecutive whole numbers."""
    return f"shiftright(cast({number} as bigint), {_BLOCK_BITS})"


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return totals(df, keys, "count(*) as _rows")


def _over(function: str, keys: list[str], order: list[str], frame: str = "") -> str:
    partition = f"partition by {', '.join(keys)} " if keys else ""
    return f"{function} over ({partition}order by {', '.join(order)} {frame})"


def _large_groups(df: DataFrame, keys: list[str], split_rows: int, sizes: DataFrame | None) -> DataFrame | None:
    """Keys and ``_rows`` of the groups of more than ``split_rows`` rows; None if there are none, which a small job tells.

    Rows are first counted by a hash of their keys, which moves ``_BUCKETS`` counts for each task at most. Groups are
    counted by themselves only if a bucket holds too many rows.
    """
    if sizes is None:
        bucket = f"pmod(xxhash64({', '.join(keys)}), {_BUCKETS})" if keys else "0L"
        counts = totals(df.selectExpr(f"{bucket} as _bucket"), ["_bucket"], "count(*) as _rows")
        if counts.filter(f"_rows > {split_rows}").isEmpty():
            return None
        sizes = group_sizes(df, *keys)
    found = sizes.filter(f"_rows > {split_rows}")
    return None if found.isEmpty() else found


def _cut(
    df: DataFrame, keys: list[str], levels: dict[str, str], split_rows: int, found: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that stay whole, and those of the large groups that were found with the level columns."""
    if keys:
        found = found.select(*keys)
        if split_rows >= SPLIT_ROWS:
            # One key for split_rows rows at most: no row is shuffled to learn its part.
            found = F.broadcast(found)
        whole, large = (_matched(df, found, keys, [], how) for how in ("left_anti", "left_semi"))
    else:
        whole, large = df.limit(0), df
    return whole, large.selectExpr("*", *[f"{value} as {name}" for name, value in levels.items()])


def _matched(left: DataFrame, right: DataFrame, keys: list[str], levels: list[str], how: str) -> DataFrame:
    """Join in which NULL keys match each other; NULL levels match nothing."""
    names = [*keys, *levels]
    other = right.selectExpr(
        *[f"{name} as _r_{name}" for name in names], f"* except ({', '.join(names)})" if names else "*"
    )
    same = [f"{k} <=> _r_{k}" for k in keys] + [f"{level} = _r_{level}" for level in levels]
    joined = left.join(other, F.expr(" and ".join(same)), how)
    return joined.drop(*[f"_r_{name}" for name in names])


def _constants(values: list, kind: str) -> str:
    """An array as one foldable text, which the parser reads faster than an expression for each value."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def _range_of(column: str, bounds: list[str], kind: str) -> str:
    """Number of the range that holds the value, by binary search: odd for a value that is a boundary, which thus has
    a range of its own, and even between two boundaries."""
    steps = ", ".join(str(1 << n) for n in reversed(range(len(bounds).bit_length())))
    array = _constants(bounds, kind)
    return (
        f"aggregate(array({steps}), 0, (i, step) -> if(i + step <= {len(bounds)}, "
        f"if(element_at({array}, i + step) <= {column}, i + step, i), i), "
        f"i -> if(i = 0, 0, 2 * i - if(element_at({array}, greatest(i, 1)) = {column}, 1, 0)))"
    )


def quantile_levels(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    split_rows: int = SPLIT_ROWS,
    sizes: DataFrame | None = None,
) -> dict[str, str]:
    """Levels that cut the large groups into cells of about ``split_rows`` rows at most; none if no group is large.

    The boundaries are quantiles over all rows of large groups together, twice as many as there are cells to fill, so
    no group has more rows in a range than all of them have. A value that is a boundary has a range of its own; if such
    ranges hold many rows, those are cut by quantiles of the next order column. Numbers, dates and times can be cut.
    Beyond ``MOST_CELLS`` times ``split_rows`` rows the cells grow in proportion.
    """
    sizes = group_sizes(df, *keys) if sizes is None else sizes
    large = sizes.filter(f"_rows > {split_rows}")
    n = large.selectExpr("sum(_rows) as n").first()["n"]
    if not n:
        return {}
    columns = [c.removesuffix(" desc") for c in order]
    rows = _matched(df.select(*dict.fromkeys([*keys, *columns])), large.select(*keys), keys, [], "left_semi") if keys else df
    kinds = dict(df.dtypes)
    levels: dict[str, str] = {}
    for depth, (column, item) in enumerate(zip(columns, order)):
        cells = min(MOST_CELLS, 2 * (-(-n // split_rows)))
        shares = _constants([i / cells for i in range(1, cells)], "double")
        quantiles = f"array_distinct(percentile_approx({column}, {shares}, {10 * cells}))"
        found = rows.selectExpr(f"cast({quantiles} as array<string>) as bounds").first()["bounds"]
        if not found:
            break
        here = _range_of(column, found, kinds[column])
        sign = "-" if item.endswith(" desc") else ""
        level = f"{sign}{here}"
        levels[f"_range{depth}"] = f"case when _range{depth - 1} % 2 <> 0 then {level} else 0 end" if depth else level
        rows = rows.filter(f"{here} % 2 <> 0")
        if depth + 1 == len(columns) or (n := rows.count()) <= split_rows:
            break
    return levels


def _preceding(cells: DataFrame, keys: list[str], levels: list[str], measure: str) -> DataFrame:
    """For each cell, ``_before``: the measure summed over the earlier cells of its group.

    One window per level; each sees only the distinct values of that level within the level above.
    """
    steps = []
    out = cells
    for depth, level in enumerate(levels):
        parent, here = keys + levels[:depth], keys + levels[: depth + 1]
        earlier = _over(f"sum({measure})", parent, [level], "rows between unbounded preceding and 1 preceding")
        step = f"_step{depth}"
        if depth == len(levels) - 1:
            out = out.selectExpr("*", f"{earlier} as {step}")
        else:
            upper = totals(cells, here, f"sum({measure}) as {measure}")
            steps_here = upper.selectExpr(*here, f"{earlier} as {step}")
            out = _matched(out, steps_here, keys, levels[: depth + 1], "inner")
        steps.append(f"coalesce({step}, 0)")
    return out.selectExpr(*keys, *levels, f"{' + '.join(steps)} as _before")


def _finish(
    large: DataFrame, before: DataFrame, keys: list[str], levels: list[str], name: str, local: str
) -> DataFrame:
    """Add the local value and what precedes the cell."""
    return _matched(large.selectExpr("*", f"{local} as _local"), before, keys, levels, "left").selectExpr(
        f"* except (_local, _before, {', '.join(levels)})", f"_local + coalesce(_before, 0) as {name}"
    )


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    levels: dict[str, str] | None,
    name: str,
    split_rows: int = SPLIT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """ROW_NUMBER over ``keys`` in ``order``."""
    number = f"cast({_over('row_number()', keys, order)} as bigint) as {name}"
    found = _large_groups(df, keys, split_rows, sizes)
    if found is None:
        return df.selectExpr("*", number)
    if levels is None:
        levels = quantile_levels(df, keys, order, split_rows, found)
    if not levels:
        return df.selectExpr("*", number)
    names = list(levels)
    whole, large = _cut(df, keys, levels, split_rows, found)
    cells = totals(large, keys + names, "count(*) as _rows")
    local = f"cast({_over('row_number()', keys + names, order)} as bigint)"
    split = _finish(large, _preceding(cells, keys, names, "_rows"), keys, names, name, local)
    return whole.selectExpr("*", number).unionByName(split)


def ranked(
    df: DataFrame,
    keys: list[str],
    value: str,
    levels: dict[str, str] | None,
    name: str,
    dense: bool = False,
    split_rows: int = SPLIT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """RANK or DENSE_RANK over ``keys`` by falling ``value``.

    ``levels`` must rise while the value falls. In a large group the rank of a value is one more than the rows (or
    distinct values) before it, so its rows only join their value's rank: no task needs to see all ties.
    """
    rank = f"cast({_over('dense_rank()' if dense else 'rank()', keys, [f'{value} desc'])} as bigint) as {name}"
    found = _large_groups(df, keys, split_rows, sizes)
    if found is None:
        return df.selectExpr("*", rank)
    if levels is None:
        levels = quantile_levels(df, keys, [f"{value} desc"], split_rows, found)
    if not levels:
        return df.selectExpr("*", rank)
    levels = {**levels, "_value": f"-({value})"}
    names = list(levels)
    whole, large = _cut(df, keys, levels, split_rows, found)
    cells = totals(large, keys + names, f"{'max(1L)' if dense else 'count(*)'} as _rows")
    split = _matched(large, _preceding(cells, keys, names, "_rows"), keys, names, "inner").selectExpr(
        f"* except ({', '.join(names)}, _before)", f"_before + 1 as {name}"
    )
    return whole.selectExpr("*", rank).unionByName(split)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    levels: dict[str, str] | None,
    amount: str,
    name: str,
    split_rows: int = SPLIT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Running total of an exact ``amount`` column over ``keys`` in ``order``."""
    frame = "rows between unbounded preceding and current row"
    total = f"{_over(f'sum({amount})', keys, order, frame)} as {name}"
    found = _large_groups(df, keys, split_rows, sizes)
    if found is None:
        return df.selectExpr("*", total)
    if levels is None:
        levels = quantile_levels(df, keys, order, split_rows, found)
    if not levels:
        return df.selectExpr("*", total)
    names = list(levels)
    whole, large = _cut(df, keys, levels, split_rows, found)
    cells = totals(large, keys + names, f"sum({amount}) as _amount")
    local = _over(f"sum({amount})", keys + names, order, frame)
    split = _finish(large, _preceding(cells, keys, names, "_amount"), keys, names, name, local)
    return whole.selectExpr("*", total).unionByName(split)


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    levels: dict[str, str],
    values: list[str],
    name: str,
    following: bool = False,
    split_rows: int = SPLIT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Struct ``name`` with ``values`` of the previous (or following) row; NULL where there is none.

    ``order`` must be ascending. At the edge of a cell the row comes from the nearest earlier (later) cell.
    """
    record, position = f"struct({', '.join(values)})", f"struct({', '.join(order)})"
    move, edge_of = ("lead", "min_by") if following else ("lag", "max_by")
    moved = f"{_over(f'{move}({record})', keys, order)} as {name}"
    found = _large_groups(df, keys, split_rows, sizes)
    if found is None:
        return df.selectExpr("*", moved)
    names = list(levels)
    whole, large = _cut(df, keys, levels, split_rows, found)
    edges = totals(large, keys + names, f"{edge_of}({record}, {position}) as _record")
    edges = edges.selectExpr(*keys, *names, f"{_over(f'{move}(_record)', keys, names)} as _edge")
    local = f"{_over(f'{move}({record})', keys + names, order)} as _local"
    split = _matched(large.selectExpr("*", local), edges, keys, names, "left").selectExpr(
        f"* except (_local, _edge, {', '.join(names)})", f"coalesce(_local, _edge) as {name}"
    )
    return whole.selectExpr("*", moved).unionByName(split)
