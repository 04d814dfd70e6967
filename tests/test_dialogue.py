"""Reply extraction, conversation window, quota, and the answer to one reply."""

import pytest

from seaflow.operators import dialogue
from seaflow.sources.fixtures import freight


@pytest.fixture(scope="module")
def extract(spark):
    def one(text):
        row = dialogue.extract_reply(spark.createDataFrame([(text,)], "text string")).first()
        return row.sql, row.explanation

    return one


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<sql>SELECT 1</sql><explanation> Why. </explanation>", ("SELECT 1", "Why.")),
        ("<SQL>\n```sql\nSELECT 1\n```\n</SQL>", ("SELECT 1", "")),
        ("Here:\n```sql\nSELECT 1\n``` done", ("SELECT 1", "Here:\n done")),
        ("```\nSELECT 2```", ("SELECT 2", "")),
        ("The answer: with a as (select 1) select * from a ", ("with a as (select 1) select * from a", "")),
        (" I cannot answer that. ", ("", "I cannot answer that.")),
        ("éselect is no word", ("", "éselect is no word")),
        ("<sql></sql>SELECT 3", ("", "")),
        (None, ("", "")),
    ],
)
def test_extract_reply(extract, text, expected):
    assert extract(text) == expected


def messages(spark, turns, conv=1):
    rows = [(conv, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_window_keeps_the_last_ten_pairs(spark):
    recent = dialogue.recent_messages(messages(spark, 26)).collect()
    assert sorted(r.turn for r in recent) == list(range(6, 26))
    assert dialogue.recent_messages(messages(spark, 6)).count() == 6


def test_window_is_cut_before_the_shuffle(spark):
    plan = dialogue.recent_messages(messages(spark, 26))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_quota(spark):
    few = dialogue.question_quota(messages(spark, 5)).first()
    assert (few.question_count, few.remaining, few.at_limit) == (2, 18, 0)
    many = dialogue.question_quota(messages(spark, 50)).first()
    assert (many.question_count, many.remaining, many.at_limit) == (25, 0, 1)


def test_cleared(spark):
    resets = spark.createDataFrame([(1, 3)], "conv_id long, turn long")
    assert dialogue.cleared(messages(spark, 6), resets).count() == 2
    assert dialogue.cleared(messages(spark, 6, conv=2), resets).count() == 6


def test_answer(spark):
    t = freight(spark, "/root/testdata/sf0.001")
    outcome, why = dialogue.answer(t, "<sql>SELECT vessel_name FROM VESSEL</sql><explanation>All.</explanation>")
    assert outcome.result.count() == 10 and why == "All." and "LIMIT" in outcome.sql
    refused, _ = dialogue.answer(t, "<sql>DROP TABLE VESSEL</sql><explanation>Gone.</explanation>")
    assert refused.result is None and refused.errors
    nothing, text = dialogue.answer(t, "Sorry, no data.")
    assert "SQL" in nothing.errors[0] and text == "Sorry, no data."
