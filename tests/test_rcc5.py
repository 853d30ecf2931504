from pyspark.sql import functions as F

from taxalign.functions import rcc5
from taxalign.operators.relations import derive_table


def test_composition_table_follows_from_models(spark):
    rows = derive_table(spark).collect()
    assert len(rows) == 25
    for r in rows:
        assert rcc5.COMPOSE[r.r * 32 + r.s] == r.composed


def test_symbols_round_trip_and_reverse(spark):
    df = spark.range(32).select(F.col("id").cast("int").alias("r"))
    rows = df.select("r", rcc5.parse(rcc5.symbol(F.col("r"))).alias("p"), rcc5.reverse(rcc5.reverse(F.col("r"))).alias("b"),
                     rcc5.symbol(F.col("r")).alias("s")).collect()
    assert all(x.r == x.p == x.b for x in rows)
    assert {x.r: x.s for x in rows}[25] == "{< ! ><}"


def test_notes_compose_and_reverse(spark):
    lit = F.lit
    eq = rcc5.predicate(lit(4), lit("x"), lit(0), lit(""))
    lt = rcc5.predicate(lit(1), lit("y"), lit(2), lit("up"))
    row = spark.range(1).select(rcc5.compose_predicates(eq, lt).alias("a"), rcc5.compose_predicates(lt, lt).alias("b"),
                                rcc5.reverse_predicate(lit("o"), lt).alias("c")).first()
    assert (row.a.relation, row.a.note) == (1, "up")
    assert (row.b.span, row.b.note) == (4, "up")
    assert (row.c.relation, row.c.target, row.c.note) == (2, "o", "←up")
