"""Co-occurrence statistics, sparse matrices and vectors of terms and records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.functions import score as S
from quipu.operators.cut import cut
from quipu.operators.skew import join_checked


def pair_counts(rows: DataFrame, tokens: Column) -> tuple[DataFrame, DataFrame, int]:
    """Pairs a < b of the distinct tokens of a record: (a, b, n), and (term, df) of the tokens, and the number of
    records of two tokens or more. A token and those after it are spelled out at a time, never all pairs of a record;
    both counts are combined before the shuffle."""
    lists = rows.select(F.array_distinct(tokens).alias("t")).where(F.size("t") >= 2)
    each = lists.select(F.array_sort("t").alias("t")).select("t", F.posexplode("t").alias("i", "a"))
    after = each.select("a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"))
    pairs = after.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    df = lists.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return pairs, df, lists.count()


def scored_pairs(pairs: DataFrame, df: DataFrame, n: int, least: int = 3) -> DataFrame:
    """a, b, n, na, nb, npmi, llr of pairs that, like both their terms, have `least` records."""
    x, y = df.where(F.col("df") >= least).select(F.col("term").alias("a"), F.col("df").alias("na")), df.where(F.col("df") >= least).select(F.col("term").alias("b"), F.col("df").alias("nb"))
    both = pairs.where(F.col("n") >= least).join(x, "a").join(y, "b")
    total = F.lit(n).cast("bigint")
    return both.withColumn("npmi", S.npmi(F.col("n"), F.col("na"), F.col("nb"), total)).withColumn("llr", S.dunning(F.col("n"), F.col("na"), F.col("nb"), total))


def directed_npmi(rows: DataFrame, tokens: Column, left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """a, b, npmi of the pairs of scored_pairs whose one word is of `left` and whose other is of `right` (each: t, distinct), as a
    and b; other pairs are not counted."""
    lists = rows.select(F.array_distinct(tokens).alias("t")).where(F.size("t") >= 2)
    df = cut(lists.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least))
    known = lambda words, c: cut(words.select(F.col("t").alias("term")).join(df, "term").select(F.col("term").alias(c), F.col("df").alias(f"n{c}")))
    a, b = known(left, "a"), known(right, "b")
    each = join_checked(lists.select("t", F.explode("t").alias("a")), a, "a", "inner").select("t", "a", "na")
    both = join_checked(each.select("a", "na", F.explode("t").alias("b")).where("a <> b"), b, "b", "inner")
    n = both.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    first, second = F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na"))
    return n.select("a", "b", S.npmi(F.col("n"), first, second, F.lit(lists.count()).cast("bigint")).alias("npmi"))


def ppmi_matrix(counts: DataFrame, smoothing: float = 0.75, shift: float = 0.0) -> DataFrame:
    """counts: doc, term, n. Cells of the positive PMI matrix: doc, term, ppmi > 0.

    Cells weigh log1p(n); term probabilities are raised to `smoothing` and made to sum to 1 again.
    """
    cells = counts.select("doc", "term", F.log1p("n").alias("w"))
    total = cells.agg(F.sum("w")).first()[0] or 1.0
    terms = cells.groupBy("term").agg(F.pow(F.sum("w") / total, F.lit(smoothing)).alias("pt"))
    norm = terms.agg(F.sum("pt")).first()[0] or 1.0
    docs = cells.groupBy("doc").agg((F.sum("w") / total).alias("pd"))
    value = F.log((F.col("w") / total) / ((F.col("pt") / norm) * F.col("pd"))) - shift
    return cells.join(terms, "term").join(docs, "doc").select("doc", "term", value.alias("ppmi")).where("ppmi > 0")


def _gram(width: int):
    """Upper triangle of the sum of outer products of a task's rows: i, j, g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _dense(b.column(0), b.column(1), width)
            total += m.T @ m
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    return run


def _dense(places: pa.Array, values: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(places), width))
    row = np.repeat(np.arange(len(places)), np.diff(np.asarray(places.offsets)))
    out[row, np.asarray(places.flatten())] = np.asarray(values.flatten())
    return out


def _projected(basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _dense(b.column(1), b.column(2), len(basis)) @ basis
            ends = np.arange(len(u) + 1, dtype=np.int32) * basis.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(u.ravel()))], ["doc", "vector"])

    return run


def truncated_svd(cells: DataFrame, terms: int = 512, rank: int = 16) -> DataFrame:
    """cells: doc, term, ppmi. doc, vector (U * sqrt(S)) over the `terms` commonest terms (ties by name).

    Tasks add up Gram matrices of terms * terms cells; their sum is all that the driver gets, however many
    documents there are. Its eigenvectors V give U * sqrt(S) = rows * V / sqrt(S). Signs are set so
    that the largest element of each direction is positive.
    """
    df = cells.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    chosen = sorted(r["term"] for r in df.orderBy(F.desc("df"), "term").limit(terms).collect())
    if not chosen:
        return cells.sparkSession.createDataFrame([], "doc string, vector array<double>")
    number = cells.sparkSession.createDataFrame([(t, j) for j, t in enumerate(chosen)], "term string, j int")
    rows = cells.join(F.broadcast(number), "term").groupBy("doc").agg(F.collect_list(F.struct("j", "ppmi")).alias("c")).select("doc", "c.j", "c.ppmi")
    width = len(chosen)
    parts = rows.select("j", "ppmi").mapInArrow(_gram(width), "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    gram = np.zeros((width, width))
    for r in parts.toLocalIterator():  # terms * (terms + 1) / 2 rows at most
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["g"]
    values, v = np.linalg.eigh(gram)
    top = np.argsort(-values)[: min(rank, width)]
    top = top[values[top] > 1e-9]
    basis = v[:, top] * np.sign(v[np.abs(v[:, top]).argmax(axis=0), top]) / values[top] ** 0.25
    return rows.mapInArrow(_projected(basis), "doc string, vector array<double>")


def weighted_mean(rows: DataFrame, by: list[str], vector: str, weight: Column, size: int) -> DataFrame:
    """by, vector: the weighted mean, a sum per element, combined before the shuffle."""
    sums = [F.sum(weight * F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_{i}") for i in range(size)]
    total = F.sum(weight)
    grouped = rows.groupBy(*by).agg(total.alias("_w"), *sums)
    return grouped.where("_w > 0").select(*by, F.array(*(F.col(f"_{i}") / F.col("_w") for i in range(size))).alias("vector"))


def normalised(vector: Column) -> Column:
    norm = F.sqrt(S.dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: F.lit(0.0)))


def retrofit(vectors: DataFrame, und: DataFrame, size: int, pull: float = 0.2) -> DataFrame:
    """One Jacobi round: (1 - pull) * own + pull * weighted mean of the neighbours (k, vector)."""
    near = und.join(vectors.select(F.col("k").alias("b"), F.col("vector").alias("v")), "b")
    mean = weighted_mean(near.select(F.col("a").alias("k"), "v", "peso"), ["k"], "v", F.col("peso"), size).withColumnRenamed("vector", "m")
    mixed = F.zip_with("vector", "m", lambda x, y: x.cast("double") * (1 - pull) + y * pull)
    return vectors.join(mean, "k", "left").select("k", F.when(F.col("m").isNull(), F.transform("vector", lambda x: x.cast("double"))).otherwise(mixed).alias("vector"))


def signature(tokens: Column, bits: int = 2048, hashes: int = 4) -> Column:
    """Set bits of a sparse binary signature: `hashes` md5 places for each token."""
    place = lambda t, k: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("#", t, k)), 1, 8), 16, 10).cast("bigint"), F.lit(bits))
    some = F.array_distinct(tokens)
    by = lambda k: lambda t: place(t, F.lit(str(k)))
    places = [F.transform(some, by(k)) for k in range(hashes)]
    return F.array_sort(F.array_distinct(F.concat(*places)))


def hamming(a: Column, b: Column) -> Column:
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def _within(radius: int, width: int):
    """Pairs p < q of a band's words within `radius`, of which no band before it has equal bits."""

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        word = np.sort(t.column("word").to_numpy())
        bare, mask, p, q = word.view(np.uint64), np.uint64((1 << width) - 1), [], []
        step = max(1, 4_000_000 // max(1, len(word)))
        for at in range(0, len(word), step):
            x, y = np.nonzero(np.bitwise_count(bare[at : at + step, None] ^ bare[None, at:]) <= radius)
            later = y > x
            p.append(x[later] + at)
            q.append(y[later] + at)
        p, q = (np.concatenate(z) if z else np.zeros(0, int) for z in (p, q))
        gap = bare[p] ^ bare[q]
        first = np.ones(len(p), dtype=bool)
        for i in range(keys[0].as_py()):
            first &= (gap >> np.uint64(i * width)) & mask != 0
        return pa.table({"p": word[p[first]], "q": word[q[first]], "distancia": np.bitwise_count(gap[first]).astype(np.int32)})

    return run


def near_by_hamming(rows: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """rows: k, word (bigint of `bits` bits). Pairs a < b within `radius` bits: a, b, distancia. Exact.

    Words are cut into radius + 1 bands; two words that near agree in one band at least. Equal words are
    one row while they meet.
    """
    bands = radius + 1
    width = -(-bits // bands)
    one = rows.where("word is not null").groupBy("word").agg(F.min("k").alias("rep"))
    bits_of = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("word", i * width).bitwiseAND((1 << width) - 1).alias("v")) for i in range(bands))))
    banded = one.select("word", bits_of.alias("x")).select("word", "x.i", "x.v")
    near = banded.groupBy("i", "v").applyInArrow(_within(radius, width), "p bigint, q bigint, distancia int")
    near = near.unionByName(one.select(F.col("word").alias("p"), F.col("word").alias("q"), F.lit(0).alias("distancia")))
    member = rows.where("word is not null").select("k", "word")
    pairs = near.join(member.select(F.col("word").alias("p"), F.col("k").alias("x")), "p").join(member.select(F.col("word").alias("q"), F.col("k").alias("y")), "q")
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distancia").distinct()
