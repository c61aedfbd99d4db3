"""Ranked retrieval of batches of queries over a field-weighted inverted index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.operators.graph import first_per

#: Queries of a batch that goes to every task, at most.
MOST_QUERIES = 100_000


def inverted_index(rows: DataFrame, key: str, fields: dict[str, tuple[Column, float]]) -> tuple[DataFrame, DataFrame]:
    """fields: tokens and weight of each. Out: postings (key, term, tf, the weighted count) and
    lengths (key, dl, the tokens of all fields)."""
    marked = [F.transform(tokens, _weigh(weight)) for tokens, weight in fields.values()]
    every = rows.select(key, F.concat(*marked).alias("t"))
    postings = every.select(key, F.explode("t").alias("p")).groupBy(key, F.col("p.term").alias("term")).agg(F.sum("p.w").alias("tf"))
    return postings, every.select(key, F.size("t").alias("dl"))


def _weigh(weight: float):
    return lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"))


def bm25(postings: DataFrame, lengths: DataFrame, asked: DataFrame, key: str, among: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """asked: consulta, term (distinct). Out: consulta, key, bm25 (greater is better), terminos (terms hit); among: only of
    these pairs of consulta and key.

    Every term counts, however common; one that most records hold has the least weight, 1e-6. The asked
    terms are broadcast and postings scored where they lie: if those of a key lie together, as
    inverted_index leaves them, the sums need no shuffle and a common term makes no hot task.
    """
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    met = postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = met.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = asked.join(df.select("term", idf.alias("idf")), "term")
    if among is None:
        hits = met.join(lengths, key).join(F.broadcast(weighed), "term")
    else:
        hits = among.join(weighed, "consulta").join(met, [key, "term"]).join(lengths, key)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (mean or 1.0)))
    return hits.groupBy("consulta", key).agg(F.round(F.sum(part), 6).alias("bm25"), F.count(F.lit(1)).alias("terminos"))


def nearest(nodes: DataFrame, key: str, asked: DataFrame, n: int) -> DataFrame:
    """nodes: key, vector; asked: consulta, vector, a batch that goes to every task. Out: consulta, key, coseno of
    the n nodes of greatest cosine above 0, ties to the least key; every node is compared."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    kind = dict(asked.dtypes)["consulta"]
    batch = asked.select("consulta", "vector").limit(MOST_QUERIES + 1).collect()
    if len(batch) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch")
    if not batch:
        return nodes.select(F.lit(None).cast(kind).alias("consulta"), key, F.lit(0.0).alias("coseno")).limit(0)
    ids, q = [r[0] for r in batch], unit(np.array([r[1] for r in batch], dtype=float))

    def run(frames):
        for pdf in frames:
            if len(pdf):
                names = pdf[key].to_numpy()
                cos = np.round(unit(np.stack([np.asarray(x, dtype=float) for x in pdf["vector"]])) @ q.T, 6)
                for j in range(len(ids)):
                    least = np.partition(cos[:, j], -n)[-n] if len(names) > n else -1.0
                    best = np.flatnonzero(cos[:, j] >= least)
                    yield pd.DataFrame({"consulta": ids[j], key: names[best], "coseno": cos[best, j]})

    scored = nodes.select(key, "vector").mapInPandas(run, f"consulta {kind}, {key} string, coseno double").where("coseno > 0")
    return first_per(scored, ["consulta"], [F.desc("coseno"), F.asc(key)], n).select("consulta", key, "coseno")


def greatest_cosine(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """nodes: quien (the queries that meet the node), vector; asked: consulta, vector, a batch that goes to every task. Out: consulta,
    c, the greatest cosine of a query and a node that it meets."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    batch = asked.select("consulta", "vector").limit(MOST_QUERIES + 1).collect()
    if len(batch) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch")
    place = {r[0]: i for i, r in enumerate(batch)}
    q = unit(np.array([r[1] for r in batch], dtype=float)) if batch else np.zeros((0, 1))

    def run(frames):
        best = np.full(len(place), -np.inf)
        for pdf in frames:
            for ids, x in zip(pdf["quien"], pdf["vector"], strict=True):
                at = np.array([place[i] for i in ids if i in place], dtype=int)
                if len(at):
                    x = np.asarray(x, dtype=float)
                    np.maximum.at(best, at, q[at] @ (x / max(np.linalg.norm(x), 1e-300)))
        yield pd.DataFrame({"consulta": [i for i, j in place.items() if best[j] > -np.inf], "c": best[best > -np.inf]})

    kind = dict(asked.dtypes)["consulta"]
    return nodes.mapInPandas(run, f"consulta {kind}, c double").groupBy("consulta").agg(F.max("c").alias("c"))
