import datetime

import pytest
from pyspark.sql import functions as F

from quipu.operators.search import bm25, inverted_index
from quipu.plans import registry
from tests.conftest import rows

T0 = datetime.datetime(2025, 1, 1)
NODE = "concepto string, contenido string, ultimo_acceso timestamp_ntz, id bigint, categoria int, peso_sinaptico double, estado string, asociaciones string, sinonimos string, creado_en timestamp_ntz, valencia_somatica double, exitos_dopamina bigint, fallos_dopamina bigint, prioridad bigint"


def folder(spark, path, nodes, cases):
    """A folder with nodes (concepto, contenido) and cases (item_id, consulta)."""
    held = [(c, t, T0, i, 1, 0.5, "activo", None, None, T0, 0.0, 0, 0, 0) for i, (c, t) in enumerate(nodes)]
    spark.createDataFrame(held, NODE).write.parquet(f"{path}/largo_plazo.parquet")
    spark.createDataFrame(cases, "item_id bigint, consulta string").write.parquet(f"{path}/casos_qa.parquet")
    return str(path)


def test_bm25_keeps_terms_that_every_record_holds(spark):
    held = spark.createDataFrame([("a", ["comun", "raro"]), ("b", ["comun"]), ("c", ["comun", "otro"])], "k string, t array<string>")
    q = spark.createDataFrame([(1, "comun"), (2, "comun"), (2, "raro")], "consulta bigint, term string")
    got = {(c, k): (s, n) for c, k, s, n in rows(bm25(*inverted_index(held, "k", {"t": (F.col("t"), 1.0)}), q, "k"))}
    assert set(got) == {(c, k) for c in (1, 2) for k in "abc"}
    assert got[2, "a"][1] == 2 and got[2, "a"][0] > got[2, "b"][0]


@pytest.fixture(scope="module")
def template(spark, tmp_path_factory):
    nodes = [(f"nodo_{i}", "plantilla comun del texto") for i in range(3)] + [("otro_nodo", "palabra distinta")]
    return folder(spark, tmp_path_factory.mktemp("plantilla"), nodes, [(1, "plantilla comun")])


def test_queries_of_common_words_find_their_nodes(spark, template):
    want = {f"nodo_{i}" for i in range(3)}
    for name in ("sf1b_bm25_topk", "se4_content_coverage", "pr12_all_terms", "pr13_coverage_gate", "se6e_near", "se6h_prefix_layer"):
        assert {r["concepto"] for r in registry.QUERIES[name](spark, template).collect()} == want, name
    assert rows(registry.QUERIES["se8_validate_words"](spark, template)) == [("comun", 3), ("plantilla", 3)]


def test_flagship_finds_what_only_another_layer_reaches(spark, tmp_path):
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(100)]
    names = ["texto_igual", "vecino_latente", "solo_vector", "solo_hub", "montanas_altas", "ajeno"]
    d = folder(spark, tmp_path, [(c, "consulta escrita" if c == "texto_igual" else "otra cosa") for c in names], [(1, "consulta escrita"), (2, "zorro"), (3, "montaxas montanaz")])
    put = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    put("sinapsis", [("texto_igual", "vecino_latente", 0.3, "manual", T0, T0)], "origen string, destino string, peso double, tipo string, creado_en timestamp_ntz, ultimo_uso timestamp_ntz")
    put("concept_hub_nodes", [("zorro", 7), ("solo_hub", 7)], "node_concepto string, hub_id bigint")
    put("nodos", [("solo_vector", axis(0)), ("ajeno", axis(1))], "concepto string, vector array<double>")
    put("tokens", [("escrita", 1, axis(0))], "token string, freq bigint, vector array<double>")
    got = {(r["consulta"], r["concepto"]) for r in registry.QUERIES["se6_hybrid_search"](spark, d).collect()}
    assert {(1, "texto_igual"), (1, "vecino_latente"), (1, "solo_vector"), (2, "solo_hub"), (3, "montanas_altas")} <= got
    assert "ajeno" not in {c for _, c in got}


def test_greatest_cosine_is_that_of_all_meetings(spark):
    """Vectors of queries are known to the tasks; rows of queries and nodes don't carry them."""
    import random

    import numpy as np

    from quipu.operators.search import greatest_cosine

    r = random.Random(1)
    vec = lambda: [r.uniform(-1, 1) for _ in range(5)]
    asked, nodes = {i: vec() for i in range(4)}, [([i for i in range(6) if r.random() < 0.5], vec()) for _ in range(20)]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {i: max(cos(q, x) for ids, x in nodes if i in ids) for i, q in asked.items()}
    got = greatest_cosine(spark.createDataFrame(nodes, "quien array<bigint>, vector array<double>"), spark.createDataFrame(list(asked.items()), "consulta bigint, vector array<double>"))
    assert {k: round(c, 9) for k, c in got.collect()} == {k: round(c, 9) for k, c in want.items()}
