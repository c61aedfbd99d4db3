import random

import numpy as np
import pytest

import quipu.llm.spans as spans
from quipu.llm.fm_index import FMIndex, united
from tests.conftest import rows


def brute(docs, size):
    holders = {}
    for d, t in docs:
        for i in range(len(t or "") - size + 1):
            holders.setdefault(t[i : i + size], set()).add(d)
    out = set()
    for d, t in docs:
        at = [i for i in range(len(t or "") - size + 1) if len(holders[t[i : i + size]]) > 1]
        run = None
        for i in at:
            if run and i <= run[1]:
                run[1] = i + size
            else:
                if run:
                    out.add((d, *run))
                run = [i, i + size]
        if run:
            out.add((d, *run))
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_index_against_brute_force(seed):
    r = random.Random(seed)
    size = r.choice([3, 5, 8, 20])
    base = "".join(r.choice("abcñ🙂" if seed % 2 else "ab") for _ in range(200))
    texts = []
    for _ in range(r.randint(1, 12)):
        t = ""
        for _ in range(r.randint(0, 4)):
            i = r.randrange(180)
            t += base[i : i + r.randint(0, 60)] + "".join(r.choice("abcdef") for _ in range(r.randint(0, 6)))
        texts.append(t)
    index = FMIndex(texts, np.arange(len(texts)), np.zeros(len(texts), bool), size)
    text, begin = index.shared_windows(size, segment=r.choice([4, 50, 3000]))
    got = sorted((k, a, b) for k in range(len(texts)) for a, b in united(begin[text == k], size))
    assert got == brute(list(enumerate(texts)), size)


@pytest.mark.parametrize("seed", range(10))
def test_matching_statistics(seed):
    """Each length given out is that of the longest match before its end that another text holds, up to the size."""
    r = random.Random(seed)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(5, 60))) for _ in range(4)]
    text, end, length = FMIndex(texts, np.arange(4), np.zeros(4, bool), 6).matching_statistics(6)
    assert len(text)
    for k, e, n in zip(text.tolist(), end.tolist(), length.tolist()):
        longest = max(m for m in range(7) if m <= e and (not m or any(texts[k][e - m : e] in t for j, t in enumerate(texts) if j != k)))
        assert n == longest


def corpus():
    r = random.Random(11)
    line = lambda n: "".join(r.choice("abcdefghij áé\n🙂") for _ in range(n))
    shared = [line(n) for n in (299, 300, 301, 450, 900, 2500)]
    docs = [(d, line(r.randint(0, 900)) + (r.choice(shared) if d % 2 else "") + line(r.randint(0, 300))) for d in range(60)]
    whole = line(700)
    docs += [(100 + k, whole) for k in range(5)] + [(200, None), (201, ""), (202, shared[4] + "z" + shared[4]), (203, line(40_000) + shared[5])]
    docs += [(300 + k, line(50) + shared[3] + line(50)) for k in range(30)]
    return docs + docs[:3]  # three rows come twice


@pytest.mark.parametrize("chars", [4_000_000, 20_000, 2_000, 700])
def test_operator_against_brute_force(spark, monkeypatch, chars):
    """As a rule, with labels split by anchor, and with groups that are cut by longer anchors."""
    monkeypatch.setattr(spans, "MOST_CHARS", chars)
    monkeypatch.setattr(spans, "SHARD_CHARS", 20_000)
    docs = corpus()
    df = spark.createDataFrame([(*x, 1) for x in docs], "_id bigint, _text string, _h int")
    assert rows(spans.shared_spans(df, 300)) == sorted(brute(docs, 300), key=repr)


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "corto")], "_id bigint, _text string")
    assert spans.shared_spans(df, 300).count() == 0
    assert spans.shared_spans(df.limit(0), 300).count() == 0
