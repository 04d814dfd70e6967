"""Read-only checks on SQL texts: an audit over a column of texts, and the guarded run of one text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from seaflow.sources.schema import TABLES
from seaflow.sources.tables import FreightTables

MAX_ROWS = 1000

# Words that never occur in a read-only query, and the tables that may be named.
BLOCKED_WORDS = (
    "INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|REPLACE|EXECUTE|EXEC|ATTACH|DETACH|VACUUM|REINDEX|PRAGMA"
)
KNOWN_TABLES = tuple(sorted(name.upper() for name in TABLES))

# A clause keyword as the last word leaves the statement incomplete.
OPEN_CLAUSES = "SELECT|FROM|JOIN|ON|WHERE|AND|OR|NOT|IN|LIKE|BY|HAVING|UNION|AS|WITH"

# Fixed patterns of the rules: a row limit, a table behind FROM or JOIN, a name defined by WITH, a literal. They are
# Java patterns, put into SQL as raw strings; \\x27 stands for the single quote.
_BLOCKED = rf"(?iU)\b({BLOCKED_WORDS})\b"
_LIMIT = r"(?i)\bLIMIT\s+(\d+)\b"
_TABLE = r"(?iU)\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_]*)"
_CTE = r"(?iU)\b([A-Za-z_][A-Za-z0-9_]*)\s+AS\s*\("
_LITERAL = r"\x27[^\x27]*(\x27|\z)|\x22[^\x22]*(\x22|\z)"
_OPEN_END = rf"(?i)\b({OPEN_CLAUSES})\z"

# Groups of built-in functions a guarded query may call: those that compute from their arguments alone. The rest (JVM
# calls, session and file information, errors on purpose) and functions of any catalog are refused.
_CLOSED_GROUPS = {"misc_funcs", "table_funcs", "generator_funcs", "variant_funcs", "st_funcs", ""}
_HARMLESS = {"typeof", "explode", "posexplode", "stack"}
_DIALECT = {"strftime", "julianday"}

# White space that is trimmed, as characters of a SQL string.
_SPACE = r"' \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0'"

# Fixed wording of the messages.
_READ_ONLY = "Only read-only SELECT queries are accepted."
_NO_COMMENTS = "The query must contain no comment syntax."


def _message(text: str) -> str:
    """A SQL string with this text; ``{name}`` in it takes the value of an expression."""
    pieces = re.split(r"\{(.*?)\}", text)
    quoted = [p if i % 2 else "'" + p.replace("'", r"\'") + "'" for i, p in enumerate(pieces)]
    return " || ".join(q for q in quoted if q != "''")


def _found(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, r'{pattern}', 1)"


def _removed(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, r'{pattern}', '')"


def _names(text: str, pattern: str) -> str:
    return f"transform(regexp_extract_all({text}, r'{pattern}', 1), name -> upper(name))"


_SECURITY = (
    ("contains(_text, '--')", _message(f"Line comments ('--') are not permitted. {_NO_COMMENTS}")),
    (
        "contains(_text, '/*') or contains(_text, '*/')",
        _message(f"Block comments ('/* … */') are not permitted. {_NO_COMMENTS}"),
    ),
    (
        f"contains(_text, ';') and contains({_removed("if(endswith(_text, ';'), left(_text, length(_text) - 1), _text)", _LITERAL)}, ';')",
        _message(
            "Multiple SQL statements are not permitted (semicolon detected outside a string literal). "
            "Send one SELECT statement at a time."
        ),
    ),
    ("_blocked <> ''", _message(f"Forbidden keyword '{{_blocked}}' is not permitted. {_READ_ONLY}")),
    (
        "_first not in ('SELECT', 'WITH')",
        _message(f"Query must begin with SELECT or WITH, got '{{_first}}'. {_READ_ONLY}"),
    ),
)
_UNKNOWN = _message(f"Unknown table referenced: '{{name}}'. Valid tables: {', '.join(KNOWN_TABLES)}.")
_INCOMPLETE = _message("SQL syntax / planning error: nothing follows '{_open_end}'.")
_APPENDED = _message(f"LIMIT {MAX_ROWS:,} appended automatically (no LIMIT clause found).")
_CLAMPED = _message(f"LIMIT clamped from {{_shown}} to {MAX_ROWS:,} (maximum rows allowed per query).")


def audit(queries: DataFrame, column: str = "sql") -> DataFrame:
    """Add ``is_valid``, ``sanitized_sql``, ``errors`` and ``warnings`` for the SQL text in ``column``.

    Security rules are all checked and all reported. Only a text that passes them gets its row limit and has its
    tables and its end looked at.
    """
    gates = ", ".join(f"case when {broken} then {message} end" for broken, message in _SECURITY)
    known = ", ".join(f"'{name}'" for name in KNOWN_TABLES)
    return (
        queries.selectExpr("*", f"trim(both {_SPACE} from coalesce({column}, '')) as _text")
        .selectExpr(
            "*",
            f"upper({_found('_text', _BLOCKED)}) as _blocked",
            rf"upper({_found('_text', r'\A(\S+)')}) as _first",
            f"trim(trailing {_SPACE} from trim(trailing ';' from _text)) as _body",
        )
        .selectExpr(
            "*",
            f"if(_text = '', array('SQL string is empty.'), array_compact(array({gates}))) as _security",
            rf"{_removed(_found('_body', _LIMIT), r'\A0+(?=\d)')} as _limit",
            f"upper({_found('_body', _OPEN_END)}) as _open_end",
        )
        .selectExpr(
            "*",
            "size(_security) = 0 as _passed",
            f"length(_limit) > 4 or coalesce(try_cast(_limit as int), 0) > {MAX_ROWS} as _over",
            rf"regexp_replace(_limit, r'(?<=\d)(?=(\d{{3}})+\z)', ',') as _shown",
        )
        .selectExpr(
            "*",
            rf"case when _limit = '' then _body || '\nLIMIT {MAX_ROWS}' "
            f"when _over then regexp_replace(_body, r'{_LIMIT}', 'LIMIT {MAX_ROWS}') else _body end as _capped",
        )
        .selectExpr(
            "*",
            f"if(_passed, array_sort(array_except(array_except({_names('_capped', _TABLE)}, "
            f"{_names('_capped', _CTE)}), array({known}))), null) as _unknown",
        )
        .selectExpr(
            *queries.columns,
            "_capped",
            f"""if(_passed,
                array_compact(transform(_unknown, name -> {_UNKNOWN})
                    || array(case when _open_end <> '' then {_INCOMPLETE} end)),
                _security) as errors""",
            f"""if(_passed,
                array_compact(array(case when _limit = '' then {_APPENDED} when _over then {_CLAMPED} end)),
                cast(array() as array<string>)) as warnings""",
        )
        .selectExpr(
            *queries.columns,
            "size(errors) = 0 as is_valid",
            "if(size(errors) = 0, _capped, '') as sanitized_sql",
            "errors",
            "warnings",
        )
    )


@dataclass
class GuardedResult:
    """Outcome of a guarded query; ``result`` is lazy and None when the text was refused."""

    sql: str
    result: DataFrame | None = None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return not self.errors


def _each(items) -> Iterator:
    """The items of a Scala sequence."""
    each = items.iterator()
    while each.hasNext():
        yield each.next()


def _nodes(gateway, plan) -> Iterator[tuple]:
    """All nodes and expressions of a parsed plan, with those of subqueries and named queries: each with its kind,
    whether it is a plan, and the named queries that SQL lets it see.

    The query of a WITH sees all its names; the body of each name sees those before it, and itself where the WITH is
    recursive; all of them see the names around the WITH. Nothing outside sees any.
    """
    stack: list[tuple] = [(plan, frozenset())]
    while stack:
        node, scope = stack.pop()
        kind = node.getClass().getSimpleName()
        is_plan = is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
        yield node, kind, is_plan, scope
        if kind == "UnresolvedWith":
            for named in _each(node.innerChildren()):
                name = named.alias().lower()
                stack.append((named, scope | {name} if node.allowRecursion() else scope))
                scope = scope | {name}
        below = list(_each(node.children()))
        if is_plan:
            below += _each(node.expressions())
            if kind != "UnresolvedWith":
                below += _each(node.innerChildren())
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            below.append(node.plan())
        elif kind == "InSubquery":
            below += [*_each(node.values()), node.query()]
        stack += [(each, scope) for each in below]


def _plan_errors(session: SparkSession, sql: str) -> list[str]:
    """What the parsed text names beyond the freight tables, the named queries in scope and harmless functions. Needs a
    session that runs in this process's JVM, not one of Spark Connect."""
    state = session._jsparkSession.sessionState()
    identifier = session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    tables = {name.lower() for name in TABLES}
    errors = []
    for node, kind, is_plan, scope in _nodes(session.sparkContext._gateway, state.sqlParser().parsePlan(sql)):
        if kind == "UnresolvedRelation":
            parts = list(_each(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in tables | scope:
                errors.append(f"Unknown table referenced: '{'.'.join(parts)}'. Valid tables: {', '.join(KNOWN_TABLES)}.")
        elif kind == "UnresolvedFunction":
            parts = list(_each(node.nameParts()))
            name = parts[-1].lower()
            if len(parts) == 1 and name in _HARMLESS | _DIALECT:
                continue
            info = state.functionRegistry().lookupFunction(identifier(name)) if len(parts) == 1 else None
            if info is None or info.isEmpty() or info.get().getGroup() in _CLOSED_GROUPS:
                errors.append(f"Function not permitted: '{'.'.join(parts)}'.")
        elif is_plan and kind not in _PLAIN_PLANS:
            errors.append(f"Part of a query not permitted: {kind}.")
        elif "Identifier" in kind:
            errors.append("Names must be written out.")
    return sorted(set(errors))


# Plans of a parsed query that only combine and compute rows; all others are refused.
_PLAIN_PLANS = {
    "Aggregate", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "LocalLimit", "Offset", "OneRowRelation", "OneRowRelation$", "Pivot", "Project", "Sort", "SubqueryAlias",
    "Union", "Unpivot", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedWith", "Window", "WithWindowDefinition", "UnresolvedOrderBy",
}


def guarded_query(t: FreightTables, sql: str, max_rows: int = MAX_ROWS) -> GuardedResult:
    """Check one SQL text, then run it over the freight tables with at most ``max_rows`` rows.

    After the rules of ``audit``, Spark parses the text, and every table, named query, function and kind of operator in
    its plan must be one that is allowed. ``sql`` of the outcome is what ran: the text in an outer query that holds
    the row limit, whatever limits the text contains. (``audit`` reports the text with its own limit clamped.)
    """
    verdict = audit(t.spark.createDataFrame([(sql,)], "sql string")).first()
    outcome = GuardedResult(sql=sql, errors=list(verdict.errors), warnings=list(verdict.warnings))
    if outcome.errors:
        return outcome
    body = sql.strip().rstrip(";").rstrip()
    try:
        outcome.errors = _plan_errors(t.sql_session(), body)
        if not outcome.errors:
            outcome.sql = f"SELECT * FROM (\n{body}\n) AS guarded LIMIT {max_rows}"
            outcome.result = t.run_query(outcome.sql)
    except (AnalysisException, ParseException) as problem:
        outcome.errors.append(f"SQL syntax / planning error: {problem}")
    return outcome
