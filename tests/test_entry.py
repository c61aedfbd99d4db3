import __spark_entry__ as entry

from quipu.plans import registry
from quipu.streaming import jobs as J
from tests.conftest import rows


def test_names_and_sql():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["consulta", "concepto", "score"] and df.count() > 0


def test_stream_gives_what_the_batch_gives(spark):
    d = "/root/testdata/sf0.001"
    batch = rows(registry.QUERIES["ca6_reinforcement"](spark, d))
    assert rows(registry.QUERIES["str4_reinforcement_stream"](spark, d).select("clave", "peso", "exitos", "eventos")) == batch


def test_stream_over_a_folder_of_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = J.run_to_end(J.fresh_only(J.read_log(spark, str(tmp_path))).select("event_id"))
    assert got.count() == events.count()


def test_core_does_not_import_the_optional_part():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quipu.llm" not in p.read_text(), p
