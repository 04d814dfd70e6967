from pyspark.sql import functions as F

from seaflow.llm import touched


def test_untouched_rows_are_none_of_the_keys(spark, monkeypatch):
    monkeypatch.setattr(touched, "FILTER_BITS", 1 << 16)
    rows = spark.range(20_000).selectExpr("if(id % 100 = 7, null, id) as id", "'t' || id % 50 as key", "id as _own")
    keys = rows.filter("id % 9 = 4 or (id is null and key = 't7')").selectExpr("id as a", "key as b").distinct()
    found = touched.with_touched(rows, [F.col("id"), F.col("key")], keys, ["a", "b"])
    wanted = {tuple(r) for r in keys.collect()}
    got = found.collect()
    assert found.columns == ["id", "key", "_own", "touched"] and len(got) == 20_000
    assert all(r["touched"] for r in got if (r["id"], r["key"]) in wanted)
    assert sum(r["touched"] for r in got if (r["id"], r["key"]) not in wanted) < 0.06 * 20_000
    nothing = touched.with_touched(rows, [F.col("id"), F.col("key")], keys.limit(0), ["a", "b"])
    assert not nothing.filter("touched").count()
