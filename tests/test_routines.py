"""User-defined functions, aggregates, table functions, procedures and scripts."""

import pandas as pd
from pyspark.sql import functions as F

from millrace import routines


class Spread:
    """Greatest minus least."""

    def __init__(self):
        self.low = self.high = None

    def accumulate(self, x):
        if x is not None:
            self.low, self.high = (x, x) if self.low is None else (min(x, self.low), max(x, self.high))

    def merge(self, other):
        for x in (other.low, other.high):
            self.accumulate(x)

    def finish(self):
        return None if self.low is None else float(self.high - self.low)


class Words:
    def eval(self, text: str):
        for i, w in enumerate(text.split()):
            yield i, w


def test_functions(spark):
    routines.sql_function(spark, "twice", "x INT DEFAULT 4", "INT", "x * 2")
    routines.sql_table_function(spark, "upto", "n INT", "i INT", "SELECT explode(sequence(1, n))")
    assert [tuple(r) for r in spark.sql("SELECT twice(3) AS a, twice() AS b").collect()] == [(6, 8)]
    assert spark.sql("SELECT sum(i) FROM upto(4)").first()[0] == 10
    routines.python_function(spark, "plus", lambda a, b: a + b, "int", strict=True)
    assert [r[0] for r in spark.sql("SELECT plus(a, 1) FROM VALUES (1), (NULL) t(a)").collect()] == [2, None]

    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper()

    routines.python_function(spark, "shout", shout, "string", vectorized=True)
    assert spark.sql("SELECT shout('a')").first()[0] == "A"
    routines.table_function(spark, "words", Words, "i int, w string")
    assert [tuple(r) for r in spark.sql("SELECT * FROM words('a b')").collect()] == [(0, "a"), (1, "b")]


def test_aggregate_merges_states(spark):
    df = spark.range(100, numPartitions=7).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    df = df.unionAll(spark.createDataFrame([(9, None)], "k long, x double"))
    got = {r.k: r.s for r in routines.aggregate(df, ["k"], Spread, ["x"], "s", "double").collect()}
    assert got == {0: 99.0, 1: 96.0, 2: 96.0, 9: None}


def test_procedures_and_scripts(spark):
    @routines.procedure("count_to")
    def count_to(session, n):
        return session.range(n).count()

    assert routines.call(spark, "COUNT_TO", 5) == 5
    out = routines.script(spark, "BEGIN DECLARE n INT DEFAULT 0; WHILE n < 3 DO SET n = n + 1; END WHILE; SELECT n AS n; END")
    assert out.first()[0] == 3
    assert routines.execute_immediate(spark, "SELECT IFF(? > 1, 'a', 'b') AS x", 2).first()[0] == "a"
