"""Question-and-answer dialogues kept as rows ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import totals
from seaflow.operators.querylog import GuardedResult, guarded_query
from seaflow.sources.tables import FreightTables

QUESTION_LIMIT = 20
HISTORY_TURNS = 10
ANSWER_ROLES = ("assistant", "model")

# Forms a reply may take. The U flag lets word boundaries see letters beyond ASCII.
_TAGGED = r"(?isU)<sql>(.*?)</sql>"
_EXPLAINED = r"(?isU)<explanation>(.*?)</explanation>"
_FENCED = r"(?isU)```(?:sql)?\s*(.*?)```"
_BARE = r"(?isU)\b((?:WITH|SELECT)\b.*)"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, r'(?U)\A\s+|\s+\z', '')"


def _found(pattern: str) -> str:
    return _strip(f"regexp_extract(_text, r'{pattern}', 1)")


def extract_reply(replies: DataFrame, column: str = "text") -> DataFrame:
    """Add ``sql`` and ``explanation`` found in a reply: a tag, else a code fence, else a bare statement.

    A reply with none of them is all explanation.
    """
    unfenced = rf"regexp_replace(regexp_replace({_found(_TAGGED)}, r'(?iU)\A```(?:sql)?\s*', ''), r'(?U)\s*```\z', '')"
    unfenced_text = _strip("regexp_replace(_text, r'(?s)```.*?```', '')")
    return (
        replies.selectExpr("*", f"coalesce({column}, '') as _text")
        .selectExpr(
            "*",
            f"case when _text rlike r'{_TAGGED}' then 'tag' when _text rlike r'{_FENCED}' then 'fence' "
            f"when _text rlike r'{_BARE}' then 'bare' else 'none' end as _form",
        )
        .selectExpr(
            "* except (_text, _form)",
            f"case _form when 'tag' then {unfenced} when 'fence' then {_found(_FENCED)} "
            f"when 'bare' then {_found(_BARE)} else '' end as sql",
            f"case _form when 'tag' then {_found(_EXPLAINED)} when 'fence' then {unfenced_text} "
            f"when 'bare' then '' else {_strip('_text')} end as explanation",
        )
    )


def recent_messages(
    messages: DataFrame, turns: int = HISTORY_TURNS, roles: tuple[str, ...] | None = None
) -> DataFrame:
    """The last ``2 * turns`` messages of every conversation, of all roles or of ``roles`` alone.

    The rank filter is applied before the shuffle as well (window group limit), so a very long conversation sends
    on no more than the window from each task.
    """
    return (
        (messages if roles is None else messages.filter(F.col("role").isin(*roles)))
        .selectExpr("*", "row_number() over (partition by conv_id order by turn desc) as _age")
        .filter(f"_age <= {2 * turns}")
        .drop("_age")
    )


def cleared(messages: DataFrame, resets: DataFrame) -> DataFrame:
    """Messages after the last reset of their conversation; ``resets`` holds ``(conv_id, turn)``."""
    last = totals(resets, ["conv_id"], "max(turn) as _reset")
    return (
        messages.join(last, "conv_id", "left").filter("_reset is null or turn > _reset").drop("_reset")
    )


def question_quota(messages: DataFrame, limit: int = QUESTION_LIMIT) -> DataFrame:
    """Answered questions per conversation and what is left of the quota; a failed call leaves no answer."""
    answers = ", ".join(f"'{role}'" for role in ANSWER_ROLES)
    return totals(messages, ["conv_id"], f"count_if(role in ({answers})) as question_count").selectExpr(
        "conv_id",
        "question_count",
        f"greatest(0, {limit} - question_count) as remaining",
        f"if(question_count >= {limit}, 1, 0) as at_limit",
    )


def answer(t: FreightTables, reply: str) -> tuple[GuardedResult, str]:
    """Run the query contained in one reply through the guard; returns the outcome and the explanation."""
    found = extract_reply(t.spark.createDataFrame([(reply,)], "text string")).first()
    if not found.sql:
        return GuardedResult(sql="", errors=["Model did not return a SQL query."]), found.explanation or reply
    outcome = guarded_query(t, found.sql)
    return outcome, found.explanation
