import random

import pytest

from quipu.llm.bpe import Automaton, Encoder, read_merges
from quipu.llm.encode import decode, encode
from quipu.llm.queries import _vocabulary

ODD = ["", " ", "   ", "\n \n x", "a" * 300, "<|endoftext|>", "don't  stop", "señal 漢字 🙂 é", "\t\r\n  x \x1c y", "x" * 20_000 + " fin", "1²½ ١٢"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(_vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_documents_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = dict(map(tuple, encode(docs, "doc_id", "text", _vocabulary()).collect()))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for k, ids in zip(texts, library([t or "" for t in texts.values()])):
        assert got[k] == ids


def test_odd_texts_and_round_trip(spark, library):
    r = random.Random(2)
    alphabet = "aaabb  \n\té漢🙂'sSt1.,-_"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(500)]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(-1, None, 0)], "k bigint, t string, ids int")
    out = encode(df, "k", "t", _vocabulary())
    got = dict(map(tuple, out.collect()))
    assert got.pop(-1) == []
    assert [got[k] for k in range(len(texts))] == library(texts)
    back = dict(map(tuple, decode(out, "k", "ids", _vocabulary()).collect()))
    assert [back[k] for k in range(len(texts))] == texts
    assert encode(df.limit(0), "k", "t", _vocabulary()).count() == 0


def test_automaton_against_merging_by_rank():
    """Any set of merges: the path of the automaton is what merging pairs by rank gives."""
    r = random.Random(7)
    for _ in range(60):
        tokens, merges = [bytes([b]) for b in b"abc"], []
        while len(merges) < 12:
            a, b = r.choice(tokens), r.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        ids = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + [a + b for a, b in merges])}
        auto, rank = Automaton(ids, merges), {m: k for k, m in enumerate(merges)}
        for _ in range(40):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            parts = [bytes([c]) for c in word]
            while True:
                best = min((rank.get(p, 99), k) for k, p in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (99, 0)
                if best[0] == 99:
                    break
                pair, k, out = merges[best[0]], 0, []
                while k < len(parts):
                    if tuple(parts[k : k + 2]) == pair:
                        out.append(pair[0] + pair[1])
                        k += 2
                    else:
                        out.append(parts[k])
                        k += 1
                parts = out
            assert auto.encode(word) == [ids[p] for p in parts], (merges, word)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(Encoder, "KEPT", 3)
    from pathlib import Path

    e = Encoder(Automaton(*read_merges(Path(_vocabulary()).read_text(encoding="utf-8"))))
    text = "uno dos tres cuatro cinco uno dos"
    assert e.encode(text) == e.encode(text)
