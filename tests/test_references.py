from datetime import datetime

import pytest

from quipu.operators.references import broken_references, reference_report
from tests.conftest import rows

T1, T2, T3 = datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 3, 1)
PARENT = "clave string, creado timestamp_ntz"
CHILD = "tabla string, campo string, fila bigint, clave string, momento timestamp_ntz, extra int"


@pytest.fixture()
def data(spark):
    parents = spark.createDataFrame([("a", T2), ("a", T3), ("b", None), (None, T1)], PARENT)
    children = spark.createDataFrame(
        [
            ("t", "x", 1, "a", T1, 0),  # late: stored after
            ("t", "x", 1, "a", T1, 0),  # delivered again
            ("t", "x", 2, "a", T2, 0),  # in time
            ("t", "x", 3, "a", None, 0),  # no time
            ("t", "x", 4, "b", T1, 0),  # parent without time
            ("t", "y", 1, "z", T1, 0),  # stored never
            ("t", "y", 2, "d", None, 0),  # deleted, no time
            ("t", "y", 3, None, T1, 0),  # refers to nothing
        ],
        CHILD,
    )
    return parents, children


def test_broken(data):
    got = broken_references(*data, 100).select("tabla", "campo", "fila", "tardia")
    assert rows(got) == [("t", "x", 1, True), ("t", "y", 1, False), ("t", "y", 2, False)]


def test_heavy_keys_take_the_broadcast_way(spark):
    parents = spark.createDataFrame([("hot", T2)], PARENT)
    children = spark.createDataFrame([("t", "x", i, "hot", T1 if i % 2 else T3, 0) for i in range(400)] + [("t", "x", 1000 + i, f"k{i}", T1, 0) for i in range(10)], CHILD)
    got = broken_references(parents, children, 410)  # a heavy key has more than one row of a thousand here
    assert got.count() == 200 + 10


def test_report(spark, data):
    deleted = spark.createDataFrame([("d",), ("d",), (None,)], "clave string")
    got = reference_report(broken_references(*data, 100), deleted)
    assert rows(got) == [("t", "x", "2025-01", 0, 0, 1), ("t", "y", "2025-01", 1, 0, 0), ("t", "y", "sin_fecha", 0, 1, 0)]


def test_empty_tables(spark, data):
    none, empty = spark.createDataFrame([], PARENT), spark.createDataFrame([], CHILD)
    assert broken_references(none, empty, 0).count() == 0
    assert broken_references(none, data[1], 100).count() == 6  # every keyed reference once
