import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import quipu.operators.unpack as unpack_module
from quipu.operators.unpack import PIECE, skeleton, splitting_rule, trimmed, unpack
from tests.conftest import rows

CASES = {
    "a, b,c": ["a", "b", "c"],
    'x;"m, n"  ; y z;': ["x", "m, n", "y z"],
    '["uno", "dos|tres", "se\\u00f1al", "veta \\"q\\""]': ["uno", "dos|tres", "señal", 'veta "q"'],
    "['a-b', 'c/d', 'e']": ["a-b", "c/d", "e"],
    "{p,q r,s}": ["p", "q r", "s"],
    "a / b / c/d /    e-f": ["a", "b", "c/d", "e-f"],
    "- uno\n- dos/tres\n- cuatro": ["uno", "dos/tres", "cuatro"],
    "x\t y\t\tz": ["x", "y", "z"],
    'm • "n ""o""" • p •': ["m", 'n "o"', "p"],
    "GRIN 99，NOMU，，\"v; k\"": ["GRIN 99", "NOMU", "v; k"],
    "a/b;c; d,e": ["a/b", "c", "d", "e"],
    ",": [],
    "  ": [],
    "": [],
    "solo uno": ["solo uno"],
    "a, a, A": ["a", "a", "A"],
    '"a|b"': ["a|b"],
    'sin "cerrar, b': ['sin "cerrar', "b"],
    "uno\r\ndos": ["uno", "dos"],
}


def test_cases(spark):
    data = [(str(k), text, "clash") for k, text in enumerate(CASES)] + [("null", None, "clash")]
    df = spark.createDataFrame(data, "id string, f string, valor string")
    got = {}
    for i, p, v in sorted(map(tuple, unpack(df, "f", ["id"]).select("id", "posicion", "valor").collect())):
        got.setdefault(i, []).append((p, v))
    for k, (text, want) in enumerate(CASES.items()):
        assert got.get(str(k), []) == list(enumerate(want, 1)), text
    assert "null" not in got


def test_long_and_empty(spark):
    long = ", ".join(f"valor {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, long)], "id int, f string")
    assert unpack(df, "f", ["id"]).count() == 20_000
    assert rows(unpack(df.limit(0), "f", ["id"])) == []


def test_generated_round_trip(spark):
    """Lists written in many styles come back as they were."""
    r = random.Random(3)
    words = ["eje", "red/azul", "pozo-frio", "Faro de mar", "señal", "a_b", "KAR 7"]
    odd = ["a, b", "c; d", "e|f", 'g "h"']
    data, want = [], []
    for k in range(300):
        values = [r.choice(words + odd) for _ in range(r.randint(1, 6))]
        style = r.randrange(6)
        quote = lambda v: '"' + v.replace('"', '""') + '"' if v in odd or r.random() < 0.2 else v
        if style == 0:
            text = json.dumps(values, ensure_ascii=r.random() < 0.5)
        elif style == 1:
            text = json.dumps(values, separators=(",", ":"))
        else:
            mark = [", ", ";", " | ", "\t"][style - 2]
            text = mark.join(quote(v) + " " * r.choice([0, 0, 2]) for v in values)
        data.append((k, text))
        want += [(k, i, v) for i, v in enumerate(values, 1)]
    got = unpack(spark.createDataFrame(data, "id int, f string"), "f", ["id"])
    assert rows(got.select("id", "posicion", "valor")) == sorted(want, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=",;|/-\n\t\"'x{[}]\\ •", max_size=12))
def test_every_skeleton_has_a_rule(s):
    _, spans = splitting_rule(s)
    at = 1
    for begin, many in spans:  # in order, without overlap, inside the text
        assert begin >= at and many > 0
        at = begin + many
    assert at <= len(s) + 1


@pytest.mark.parametrize("marks", [",", "/", "-", "•"])
def test_rule_splits_at_its_marks(marks):
    text = f"x {marks} x"
    single, spans = splitting_rule(text)
    assert not single and [text[b - 1 : b - 1 + n].strip() for b, n in spans] == ["x", "x"]


def test_skeletons_have_a_character_a_piece(spark):
    data = [(t,) for t in [*CASES, "señal 🙂x, “y”\u00a0z", "a\r\n b\\n", "日本、x"] if t.strip()]
    df = spark.createDataFrame(data, "f string").select(skeleton(F.col("f")).alias("s"), F.regexp_extract_all(trimmed(F.col("f")), F.lit(PIECE), F.lit(0)).alias("p"))
    for r in df.collect():
        assert len(r["s"]) == len(r["p"]), r


def test_many_rules_are_joined(spark, monkeypatch):
    monkeypatch.setattr(unpack_module, "BROADCAST_CHARS", 10)
    test_cases(spark)
    test_generated_round_trip(spark)
