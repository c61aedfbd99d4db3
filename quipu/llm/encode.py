"""Encoding of whole corpora with a public byte-level BPE tokenizer, and decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quipu.llm.bpe import Automaton, Encoder, read_merges

#: A vocabulary file has a fixed size, a few MB, and its automaton too; this bounds what is read and broadcast.
MOST_BYTES = 32 << 20


@lru_cache(maxsize=4)
def _compiled(content: str) -> Automaton:
    return Automaton(*read_merges(content))


@lru_cache(maxsize=1)
def _encoder(automaton: Automaton) -> Encoder:
    """One per Python worker and broadcast automaton; it lives as long as the worker."""
    return Encoder(automaton)


def _automaton(rows: DataFrame, path: str):
    """The automaton of the vocabulary file, compiled on the driver and broadcast."""
    content = Path(path).read_text(encoding="utf-8")
    if len(content) > MOST_BYTES:
        raise ValueError(f"{path} is no vocabulary file: {len(content)} characters")
    return rows.sparkSession.sparkContext.broadcast(_compiled(content))


def _by_batch(make: Callable[[list], pa.Array], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), make(b.column(1).to_pylist())], ["_k", name])

    return run


def encode(rows: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Token ids of every text: key, ids (array<int>), one row per input row.

    Special tokens' strings are ordinary text. Null and empty texts give an empty list. path
    is the tokenizer's vocabulary file, compiled on the driver and broadcast as tables (some 10 MB); nothing is shuffled.
    """
    automaton = _automaton(rows, path)

    def ids(texts: list) -> pa.Array:
        encoder = _encoder(automaton.value)
        parts = [encoder.encode(t) if t else b"" for t in texts]
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(rows[f"`{key}`"].alias("_k"), rows[f"`{text}`"].alias("_t")).mapInArrow(_by_batch(ids, "ids"), f"_k {kind}, ids array<int>").withColumnRenamed("_k", key)


def decode(rows: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """Texts of lists of ids: key, text. Null lists give null; unknown ids raise."""
    automaton = _automaton(rows, path)

    def texts(lists: list) -> pa.Array:
        label = dict(zip(automaton.value.id, automaton.value.text))
        return pa.array([None if x is None else b"".join([label[i] for i in x]).decode("utf-8", "replace") for x in lists], pa.string())

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(rows[f"`{key}`"].alias("_k"), rows[f"`{ids}`"].alias("_t")).mapInArrow(_by_batch(texts, "text"), f"_k {kind}, text string").withColumnRenamed("_k", key)
