from quipu.plans import registry
from tests.conftest import rows
from tests.test_search import folder


def test_names_known_are_not_sought_again(spark, tmp_path, monkeypatch):
    """Each stage is asked for the names only that those before it leave."""
    from quipu.plans import recall

    d = folder(spark, tmp_path, [("puerta_roja", "nada"), ("ventana_azul", "nada"), ("otro_nodo", "bajo la luna llena del mar")], [(1, "algo")])
    spark.createDataFrame([("puerta_roja",), ("ventana_azull",), ("luna_llena_del",)], "concepto string").write.parquet(f"{d}/sync_log.parquet")
    spark.createDataFrame([(None,)], "node_concepto string").write.parquet(f"{d}/concept_hub_nodes.parquet")
    seen, alike, phrase = [], recall.alike_names, recall.phrase_hits
    note = lambda f: lambda v, *a: (seen.append(rows(a[-1].select("consulta"))), f(v, *a))[1]
    monkeypatch.setattr(recall, "alike_names", note(alike))
    monkeypatch.setattr(recall, "phrase_hits", note(phrase))
    want = [("luna_llena_del", "otro_nodo", 3), ("puerta_roja", "puerta_roja", 1), ("ventana_azull", "ventana_azul", 2)]
    for name in ("se1_staged_lookup", "se2_deep_lookup"):
        seen.clear()
        assert rows(registry.QUERIES[name](spark, d)) == want
        assert seen == [[("luna_llena_del",), ("ventana_azull",)], [("luna_llena_del",)]]
