from pyspark.sql import functions as F

from lodestone.functions import temporal as tm
from lodestone.functions import text as tx
from lodestone.operators import filters


def one(spark, expression, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in values.items())).select(expression.alias("x")).first()["x"] if names else None


def test_grams(spark):
    assert one(spark, tx.index_grams(F.col("t")), t="만든 책 abc") == ["만", "든", "만든", "책"]
    assert one(spark, tx.query_grams(F.col("t")), t="윌의 책 서울시") == ["윌의", "윌", "책", "서울", "울시"]


def test_tokens(spark):
    assert sorted(one(spark, tx.content_tokens(F.col("t")), t="The Plan of a b2 PLAN")) == ["b2", "plan"]
    assert one(spark, tx.is_keyword_query(F.col("t")), t="budget 2024") is True
    assert one(spark, tx.is_keyword_query(F.col("t")), t="what is due") is False


def test_numbers_and_negation(spark):
    assert one(spark, tx.numbers(F.col("t")), t="on 2026-07-15 it cost 1,200 or 3.5") == ["1200", "3.5"]
    assert one(spark, tx.has_negation(F.col("t")), t="It does not work") is True


def test_distance():
    assert tx.osa_distance("ca", "abc", 5) == 3
    assert tx.osa_distance("form", "from", 2) == 1
    assert tx.osa_distance("kitten", "sitting", 2) == 3


def test_temporal(spark):
    now = 1_784_419_200.0  # a Sunday noon: 2026-07-19
    day = lambda s: tm.DAY * (s // tm.DAY)
    ask = lambda q: one(spark, tm.temporal_intent(F.col("q"), F.col("n")), q=q, n=now)
    assert (ask("what about yesterday")["lo"], ask("what about yesterday")["hi"]) == (day(now) - tm.DAY, day(now))
    assert ask("3 days ago")["lo"] == day(now) - 4 * tm.DAY and ask("3 days ago")["hi"] == day(now) - tm.DAY
    assert ask("recently said")["recent"] is True and ask("recently said")["lo"] is None
    assert ask("plain")["recent"] is False
    weekday = int(day(now) / tm.DAY + 3) % 7
    monday = day(now) - weekday * tm.DAY
    assert (ask("last week")["lo"], ask("last week")["hi"]) == (monday - 7 * tm.DAY, monday)


def test_operators(spark):
    s = one(spark, filters.parse_operators(F.col("q")), q='tag:#Work folder:"My Notes" after:2026-01 before:2026 status:open the budget')
    assert (s["clean"], s["tags"], s["folders"], s["status"]) == ("the budget", ["work"], ["my notes"], ["open"])
    assert s["lo"] == 1_767_225_600.0 and s["hi"] == 1_798_761_600.0


def test_recency(spark):
    assert one(spark, tm.recency_weight(F.col("t"), F.col("n")), t=0.0, n=22 * tm.DAY) == 0.5
