"""Long exact spans shared between records: anchors bring candidates together, an FM-index per
shard decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.llm.fm_index import FMIndex, united
from quipu.operators.cut import cut
from quipu.operators.skew import heavy_keys, join_checked, join_with_heavy, spread

#: Characters of a shard's index aimed at, and of different text that one group may have: it goes to one index.
SHARD_CHARS, MOST_CHARS = 1_000_000, 4_000_000
#: Characters hashed at a time in a task.
STRETCH = 1 << 17


def anchor_width(least: int) -> int:
    """Characters of an anchor: the greatest power of two in half the length of a span."""
    return 1 << max(0, (least // 2).bit_length() - 1)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit numbers of all windows of `width` (a power of two) codes."""
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        b, have = np.uint64(0x9E3779B97F4A7C15), 1
        while have < width:
            h = h[:-have] * b + h[have:]
            b, have = b * b, 2 * have
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(30))


def anchors_of(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, number) of the anchors: in every stretch of `least` characters of one text
    the smallest of its windows of anchor_width, so equal stretches hold an equal anchor."""
    width = anchor_width(least)
    many = least - width + 1
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    if len(raw) < least:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    owner = np.repeat(np.arange(len(texts)), lengths)
    within = np.arange(len(raw)) - begin[owner]
    h = rolling(raw, width)
    low = _slide(h, many, np.minimum)
    low[(within > (lengths - least)[owner])[: len(low)]] = 0  # these windows leave their text
    edge = np.zeros(many - 1, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), many, np.maximum)
    place = np.flatnonzero((high == h) & (high > 0))
    return owner[place], within[place], h[place]


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            keep = [k for k, t in enumerate(texts) if t is not None and len(t) >= least]
            lo = 0
            while lo < len(keep):
                hi, size = lo, 0
                while hi < len(keep) and (hi == lo or size < STRETCH):
                    size += len(texts[keep[hi]])
                    hi += 1
                text, place, number = anchors_of([texts[k] for k in keep[lo:hi]], least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(keep[lo:hi])[text])), pa.array(place.astype(np.int64)), pa.array(number.view(np.int64))], ["_id", "_p", "_h"])
                lo = hi

    return run


def _labelled(anchors: DataFrame, least: int) -> DataFrame:
    """_id, _p, _run, _h, _l: anchors of one stretch of a text make a run, and anchors that share runs
    get one label, as far as three rounds carry it. Labels of so many anchors that their text might exceed MOST_CHARS fall
    apart to the anchors' own numbers (_own). The label depends on _h alone, so equal anchors share it."""
    most = MOST_CHARS // (4 * least)  # an anchor brings less than 2 * least characters, and so does the end of a run
    by_text = Window.partitionBy("_id").orderBy("_p")
    new = F.col("_p") - F.lag("_p").over(by_text) > 2 * least - anchor_width(least)
    runs = anchors.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(by_text)).drop("_new")
    labels = None
    for _ in range(3):
        now = runs.withColumn("_l", F.col("_h")) if labels is None else join_with_heavy(runs, labels, "_h", heavy_keys(runs, "_h", _count(anchors)))
        least_of_run = F.min("_l").over(Window.partitionBy("_id", "_run"))
        labels = cut(now.withColumn("_l", least_of_run).groupBy("_h").agg(F.min("_l").alias("_l"), F.count(F.lit(1)).alias("_n")).select("_h", "_l", "_n"))
        kept, labels = labels, labels.select("_h", "_l")
    sizes = kept.groupBy("_l").agg(F.sum("_n").alias("_all"))
    final = kept.join(sizes, "_l").select("_h", F.when(F.col("_all") <= most, F.col("_l")).otherwise(F.col("_h")).alias("_l"), (F.col("_all") > most).alias("_own"))
    return join_with_heavy(runs, final, "_h", heavy_keys(runs, "_h", _count(anchors)))


def _count(rows: DataFrame) -> int:
    return rows.count()


def _pieces(width: int):
    """Rows (_id, _b, _l, _c, _t, _x, _y): a piece's place, label, name and text, and where its (first) anchor lies in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out = []
            for i, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for p in places:
                    piece = text[p["_b"] : p["_e"]]
                    out.append((i, p["_b"], p["_l"], xxhash.xxh3_128_hexdigest(piece.encode("utf-8")), piece, p["_x"], p["_x"] + width))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["_id", "_b", "_l", "_c", "_t", "_x", "_y"])

    return run


def _in_shard(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = list(batches)  # a partition is a shard
        if any(len(b) for b in every):
            yield found(pd.concat(every, ignore_index=True))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        index = FMIndex(pdf["_t"].tolist(), pdf["_lo"].to_numpy(), (pdf["_lo"] != pdf["_hi"]).to_numpy(), least)
        text, begin = index.shared_windows(least)
        order = np.argsort(text, kind="stable")
        text, begin = text[order], begin[order]
        labels, names = pdf["_l"].to_numpy(), pdf["_c"].to_numpy()
        out = []
        for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1):
            if len(part):
                k = text[part[0]]
                out += [(labels[k], names[k], a, e) for a, e in united(begin[part], least)]
        return pd.DataFrame(out, columns=["_l", "_c", "_x", "_y"]).astype({"_l": "int64", "_c": str, "_x": "int64", "_y": "int64"})

    return run


def _longer(least: int):
    """Pieces of a group that is too large, regrouped: every window of `least` characters around the anchor goes on over half of what
    is missing on its left or on its right, so each piece is cut to these two cases, and the text they add names
    the new groups. _x, _y: the anchor's place in the piece; _s: the piece's place in the one it came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out = []
            for key, shift, group, text, x, y, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                more = -(-(least - (y - x)) // 2)
                for side, u, v in (("<", x - more, y), (">", x, y + more)):
                    if u < 0 or v > len(text):
                        continue
                    begin, end = max(0, v - least), min(len(text), u + least)
                    if end - begin < least:
                        continue
                    added = text[u:x] if side == "<" else text[y:v]
                    piece = text[begin:end]
                    name = xxhash.xxh64_intdigest(f"{group}{side}{added}") - (1 << 63)
                    out.append((key, shift + begin, name, xxhash.xxh3_128_hexdigest(piece), piece, u - begin, v - begin, lo, hi))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["_k", "_s", "_l", "_c", "_t", "_x", "_y", "_lo", "_hi"])

    return run


def _groups(pieces: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Texts to be indexed (_l, _c, _t, _lo, _hi), at most MOST_CHARS a group _l; and where each lies in the pieces' classes:
    _k (of the class), _s (place in it), _l, _c.

    Groups around one anchor that are too large are regrouped by a longer one, as often as needed: an anchor
    of `least` characters has only one text around it."""
    columns = ["_k", "_s", "_l", "_c", "_t", "_x", "_y", "_lo", "_hi"]
    classes = pieces.groupBy("_l", "_c").agg(F.min("_t").alias("_t"), F.min("_x").alias("_x"), F.min("_y").alias("_y"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    rows = cut(classes.select(F.concat_ws("-", "_l", "_c").alias("_k"), F.lit(0).cast("bigint").alias("_s"), "_l", "_c", "_t", "_x", "_y", "_lo", "_hi"))
    texts, places = [], []
    while True:
        once = rows.groupBy("_l", "_c").agg(F.min("_t").alias("_t"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")) if texts else rows.select("_l", "_c", "_t", "_lo", "_hi")
        large = cut(once.groupBy("_l").agg(F.sum(F.length("_t")).alias("_n")).where(F.col("_n") > MOST_CHARS).select("_l"))
        texts.append(join_checked(once, large, "_l", "left_anti"))
        places.append(join_checked(rows, large, "_l", "left_anti").select("_k", "_s", "_l", "_c"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, texts), reduce(DataFrame.unionByName, places)
        big = join_checked(rows, large, "_l", "left_semi").select("_k", "_s", "_l", "_t", "_x", "_y", "_lo", "_hi")
        kinds = "_k string, _s bigint, _l bigint, _c string, _t string, _x bigint, _y bigint, _lo bigint, _hi bigint"
        rows = cut(big.repartition(F.xxhash64("_k", "_s")).mapInArrow(_longer(least), kinds).select(columns))


def shared_spans(documents: DataFrame, least: int) -> DataFrame:
    """Maximal runs of characters that lie in `least` characters that another document holds too.

    documents: _id (bigint), _text. Out: _id, inicio, fin (from inicio, counted from 0, up to and without
    fin; code points). Repeated rows of an _id are one document. Null and short texts give nothing.

    1. Anchors: about one in 86 characters; equal stretches hold an equal one. Anchors of one
       document only are dropped, which leaves the text around shared anchors.
    2. Anchors that share runs of text get one label; a run goes once to each label it has. Copies of a
       piece become one text with the least and greatest document that has it, before anything is gathered.
    3. Labels are hashed into shards of about SHARD_CHARS characters, a partition each, which builds an FM-index
       of its texts, and the texts are streamed against it backwards, for matching statistics up to `least`.
    A label of so many anchors that its text might exceed MOST_CHARS is split by anchor, with the least text around each, and one
    anchor that has more different text around it by longer anchors (see _groups). The index decides in every case.
    """
    spark = documents.sparkSession
    rows = documents.where("_id is not null and _text is not null").select("_id", "_text")
    every = cut(rows.mapInArrow(_anchors(least), "_id bigint, _p bigint, _h bigint"))
    shared = every.groupBy("_h").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo < _hi").select("_h")
    anchors = cut(join_with_heavy(every, shared, "_h", heavy_keys(every, "_h", every.count())).distinct())
    marked = _labelled(anchors, least)

    width = anchor_width(least)
    whole = marked.where("not _own").groupBy("_id", "_run", "_l", "_own")
    bounds = marked.groupBy("_id", "_run").agg(F.min("_p").alias("_f"), F.max("_p").alias("_g"))
    runs = whole.agg(F.count(F.lit(1))).join(bounds, ["_id", "_run"]).select("_id", "_f", "_g", "_l")
    alone = marked.where("_own").select("_id", F.col("_p").alias("_f"), F.col("_p").alias("_g"), "_l")
    first = F.greatest(F.lit(0), F.col("_f") - (least - width))
    places = runs.unionByName(alone).select("_id", F.struct(first.alias("_b"), (F.col("_g") + least).alias("_e"), "_l", (F.col("_f") - first).alias("_x")).alias("_s"))
    wanted = places.groupBy("_id").agg(F.collect_list("_s").alias("_s"))
    pieces = cut(rows.join(wanted, "_id").select("_id", "_text", "_s").mapInArrow(_pieces(width), "_id bigint, _b bigint, _l bigint, _c string, _t string, _x bigint, _y bigint"))

    texts, classes = _groups(pieces, least)
    texts = cut(texts)
    total = texts.agg(F.sum(F.length("_t"))).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "_id bigint, inicio bigint, fin bigint")
    shards = max(1, -(-total // SHARD_CHARS))
    covered = spread(texts, "_l", parts=shards).mapInPandas(_in_shard(least), "_l bigint, _c string, _x bigint, _y bigint")

    # a third of all rows may be copies of one piece: its ranges are joined where the rows lie
    ranges = F.collect_list(F.struct((F.col("_s") + F.col("_x")).alias("_x"), (F.col("_s") + F.col("_y")).alias("_y")))
    held = cut(covered.join(classes, ["_l", "_c"]).groupBy("_k").agg(ranges.alias("_r")))
    named = pieces.select("_id", "_b", F.concat_ws("-", "_l", "_c").alias("_k"))
    found = join_with_heavy(named, held, "_k", heavy_keys(named, "_k", pieces.count()))
    ranges = found.select("_id", "_b", F.explode("_r").alias("_s")).select("_id", (F.col("_b") + F.col("_s._x")).alias("_x"), (F.col("_b") + F.col("_s._y")).alias("_y")).distinct()

    by_id = Window.partitionBy("_id").orderBy("_x", "_y")
    reach = F.max("_y").over(by_id.rowsBetween(Window.unboundedPreceding, -1))
    parted = ranges.withColumn("_new", F.coalesce(F.col("_x") > reach, F.lit(True)).cast("int")).withColumn("_n", F.sum("_new").over(by_id))
    return parted.groupBy("_id", "_n").agg(F.min("_x").alias("inicio"), F.max("_y").alias("fin")).select("_id", "inicio", "fin")
