"""Binary signatures of nodes: 2048 bits in five segments, as sorted arrays of the set ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.operators.graph import first_per

# First bit and size of each segment, weight of its bits, hashes a token.
CONTENT, CONCEPT, DIMENSIONS, CATEGORY, NEIGHBOURS = (0, 512), (512, 256), (768, 1024), (1792, 128), (1920, 128)
WEIGHTS = ((768, 1.0), (1792, 2.5), (1920, 1.5), (2048, 1.2))
#: Queries compared at a time, and most of them in a batch that goes to every task.
BLOCK, MOST_QUERIES = 256, 100_000


def _place(token: Column, segment: tuple[int, int], seed: int = 0) -> Column:
    """The bit of a token: its digest modulo the size, a power of two, so the last four digits decide."""
    text = F.concat(F.lit(f"{seed}:"), token) if seed else token
    return (F.pmod(F.conv(F.right(F.md5(text), F.lit(4)), 16, 10).cast("int"), F.lit(segment[1])) + segment[0]).cast("int")


def _places(tokens: Column, segment: tuple[int, int], hashes: int) -> Column:
    by = lambda k: lambda t: _place(t, segment, k)
    return F.flatten(F.array(*(F.transform(tokens, by(k)) for k in range(hashes))))


def _bound(places: Column, category: Column) -> Column:
    """Content bits bound to the category: those under its 32-bit mask move on together."""
    h = F.conv(F.right(F.md5(category), F.lit(8)), 16, 10).cast("bigint")
    return F.transform(places, lambda p: F.when((F.floor(h / F.pow(F.lit(2), (p % 32).cast("double"))) % 2) == 1, ((p + h % 64) % CONTENT[1]).cast("int")).otherwise(p))


def signatures(nodes: DataFrame, dims: DataFrame, und: DataFrame) -> DataFrame:
    """concepto, b: the sorted set bits of every node.

    nodes: concepto, palabras (words of the content), nombre (words of the concept), categoria (name or null); dims: concepto, dim, idf;
    und: a, b. All words count. Bits of dimensions and neighbours are made distinct before they are gathered, so
    a hub brings as many as its segment has.
    """
    category = F.lower("categoria")
    content = _places(F.array_distinct("palabras"), CONTENT, 4)
    own = F.concat(
        F.when(category.isNull(), content).otherwise(_bound(content, category)),
        _places(F.array_distinct("nombre"), CONCEPT, 4),
        F.when(category.isNull(), F.array().cast("array<int>")).otherwise(_places(F.array(category), CATEGORY, 8)),
    )
    bits = nodes.select("concepto", F.explode(own).alias("p"))
    width = F.when(F.col("idf") > 3.0, 16).when(F.col("idf") > 1.5, 12).when(F.col("idf") > 0.5, 8).otherwise(4)
    window = F.transform(F.sequence(F.lit(0), width - 1), lambda i: (F.pmod(_place(F.col("dim"), DIMENSIONS) - DIMENSIONS[0] + i, F.lit(DIMENSIONS[1])) + DIMENSIONS[0]).cast("int"))
    near = und.select(F.col("a").alias("concepto"), F.explode(_places(F.array(F.col("b")), NEIGHBOURS, 4)).alias("p"))
    other = dims.select("concepto", F.explode(window).alias("p")).unionByName(near).join(nodes.select("concepto"), "concepto", "left_semi")
    return bits.unionByName(other).distinct().groupBy("concepto").agg(F.array_sort(F.collect_list("p")).alias("b"))


def weight(bits: Column) -> Column:
    """Summed weight of set bits by their segments."""
    of = lambda p: F.when(p < WEIGHTS[0][0], WEIGHTS[0][1]).when(p < WEIGHTS[1][0], WEIGHTS[1][1]).when(p < WEIGHTS[2][0], WEIGHTS[2][1]).otherwise(WEIGHTS[3][1])
    return F.aggregate(bits, F.lit(0.0), lambda s, p: s + of(p))


def weighted_jaccard(a: Column, b: Column) -> Column:
    both = weight(F.array_intersect(a, b))
    union = weight(a) + weight(b) - both
    return F.when(union > 0, F.round(both / union, 4)).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    return (F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))).cast("int")


def _rows_of(bits: pd.Series) -> np.ndarray:
    out = np.zeros((len(bits), 2048), np.float32)
    for k, b in enumerate(bits):
        out[k, np.asarray(b, dtype=np.int64)] = 1
    return out


def search(index: DataFrame, asked: DataFrame, radius: int, n: int) -> DataFrame:
    """The n signatures of greatest weighted Jaccard within `radius` bits of each query: consulta, concepto, distancia, s.

    asked: consulta, b, a stated batch of at most MOST_QUERIES, which goes to every task and is compared in blocks.
    Every node is compared; ties go to the least name.
    """
    batch = asked.limit(MOST_QUERIES + 1).collect()
    if len(batch) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch")
    segment = np.concatenate([np.full(end - begin, w, np.float32) for (end, w), begin in zip(WEIGHTS, (0, *(e for e, _ in WEIGHTS)))])
    ids, q = [r["consulta"] for r in batch], _rows_of(pd.Series([r["b"] for r in batch]))

    def run(frames):
        for pdf in frames:
            x, names = _rows_of(pdf["b"]), pdf["concepto"].to_numpy()
            for lo in range(0, len(ids), BLOCK):
                part = q[lo : lo + BLOCK]
                common, weighted = part @ x.T, (part * segment) @ x.T
                far = part.sum(axis=1)[:, None] + x.sum(axis=1)[None, :] - 2 * common
                union = (part @ segment)[:, None] + (x @ segment)[None, :] - weighted
                s = np.round(np.where(union > 0, weighted / np.maximum(union, 1e-9), 0).astype(np.float64), 4)
                s[far > radius] = -1
                least = -np.partition(-s, min(n, s.shape[1]) - 1, axis=1)[:, min(n, s.shape[1]) - 1]
                i, j = np.nonzero((s >= least[:, None]) & (s >= 0))
                yield pd.DataFrame({"consulta": [ids[lo + k] for k in i], "concepto": names[j], "distancia": far[i, j].astype(np.int32), "s": s[i, j]})

    found = index.select("concepto", "b").mapInPandas(run, "consulta bigint, concepto string, distancia int, s double")
    return first_per(found, ["consulta"], [F.desc("s"), F.asc("concepto")], n).drop("rango")
