import random

import numpy as np
import pyarrow as pa

from quipu.operators import distribution as D
from tests.conftest import rows


def test_words_of_a_common_band_come_once(spark):
    r = random.Random(4)
    words = sorted({r.getrandbits(12) << 52 | r.getrandbits(4) << 20 for _ in range(300)})
    signed = [w - 2**64 if w >= 2**63 else w for w in words]
    df = spark.createDataFrame([(f"k{i:03}", w) for i, w in enumerate(signed)], "k string, word bigint")
    want = [(f"k{i:03}", f"k{j:03}", d) for i in range(len(words)) for j in range(i + 1, len(words)) if (d := (words[i] ^ words[j]).bit_count()) <= 7]
    assert rows(D.near_by_hamming(df, 7)) == sorted(want, key=repr)


def test_a_band_gives_only_near_pairs_that_no_band_before_it_gave():
    word = pa.table({"word": np.array([0, 1 << 20, 1 << 60, 0b11 << 8], dtype=np.int64)})
    of = lambda i: D._within(7, 8)((pa.scalar(i),), word).num_rows
    assert [of(0), of(1), of(7)] == [6, 0, 0]
    assert D._within(0, 64)((pa.scalar(0),), word).num_rows == 0
