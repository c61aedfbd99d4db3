from quipu.operators import graph as G
from tests.conftest import rows


def test_names_come_back_in_their_order(spark):
    """Only numbers meet; a < b holds for the names that come out, whatever the order of the rows."""
    names = ["z", "ñu", "B", "a", "é"]
    und = spark.createDataFrame([(x, y, 1.0) for x in names for y in names if x != y], "a string, b string, peso double")
    got = rows(G.adamic_adar(und))
    assert [(a, b) for a, b, _ in got] == sorted(((x, y) for x in names for y in names if x < y), key=repr)
    met = G._adamic_adar(spark.createDataFrame([(i, j) for i in range(5) for j in range(5) if i != j], "a bigint, b bigint"))
    assert {round(w, 9) for *_, w in got} == {round(r["adamic_adar"], 9) for r in met.collect()}
