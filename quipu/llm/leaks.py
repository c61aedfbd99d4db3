"""Evaluation passages that stand, whole or in part, in corpus documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.operators.cut import cut
from quipu.operators.skew import heavy_keys, join_checked, spread

#: Consecutive words that make a leak.
LEAST_WORDS = 12
#: Bits of the sieve per window of a passage, as a power of two, and least and most bits of all (16 MB).
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 6, 16, 27
#: Parts of a window that many documents hold.
SALTS = 32
_WORD = re.compile(r"[^\W_]+").findall
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits after NFKD, removal of combining marks and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _MARKS.sub("", text)
        if not text.isascii():
            text = "".join([c for c in text if not unicodedata.combining(c)])
    return _WORD(text.lower())


class _Numbers(dict):
    """64-bit numbers of words, kept for the words that come again."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word)
        return n


_numbers = _Numbers()


def windows(words_: list[str], size: int) -> np.ndarray:
    """Karp-Rabin numbers of all windows of so many words, doubling the window as far as it goes."""
    n = len(words_) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_numbers.__getitem__, words_), dtype=np.uint64, count=len(words_))
    out, base, have, width, left = None, _BASE, 0, 1, size
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                out = h[:n] if out is None else out * base + h[have : have + n]
                have += width
            left >>= 1
            if not left:
                break
            h = h[:-width] * base + h[width:]
            base, width = base * base, 2 * width
        out = out ^ (out >> np.uint64(29))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def _places(h: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the sieve that stand for each number."""
    return h >> np.uint64(64 - power), (h << np.uint64(power)) >> np.uint64(64 - power)


def _windows_of(size: int, power: int, sieve):
    """Rows (_id, _h, _p, _w) of the windows of each text that pass the sieve."""
    schema = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("_p", pa.int32()), ("_w", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(sieve.value, np.uint8), bitorder="little").view(bool)
        for b in batches:
            ids, hashes, places, texts = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                h = windows(w, size)
                one, two = _places(h, power)
                at = np.flatnonzero(bits[one])
                at = at[bits[two[at]]]
                if len(at):
                    ids.append(np.full(len(at), i, np.int64))
                    hashes.append(h[at].view(np.int64))
                    places.append(at.astype(np.int32))
                    texts += [" ".join(w[p : p + size]) for p in at.tolist()]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places)), pa.array(texts, pa.string())], schema=schema)

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_item, _k, _words, largo): passages of the same words are one class _k."""
    import xxhash

    for b in batches:
        split = [words(t) for t in b.column(1).to_pylist()]
        texts = [" ".join(w) for w in split]
        names = [xxhash.xxh3_128_digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(texts, pa.string()), pa.array([len(w) for w in split], pa.int32())], ["_item", "_k", "_words", "largo"])


def _seeds(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = text.split(" ")
                h = windows(w, size)
                if len(h):
                    v = [" ".join(w[p : p + size]) for p in range(len(h))]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(h), pa.binary()), pa.array(h.view(np.int64)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(v)], ["_k", "_h", "_q", "_v"])

    return run


def _sieve(seeds: DataFrame, power: int) -> bytes:
    """A bitmap of 2**power bits with two for every window; united in Spark, a word of 64 bits a row."""
    place = F.explode(F.array(F.shiftrightunsigned("_h", 64 - power), F.shiftrightunsigned(F.shiftleft("_h", power), 64 - power))).alias("_b")
    bit = F.expr("shiftleft(1L, cast(_b & 63 as int))")
    found = seeds.select(place).groupBy(F.shiftright("_b", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.int64)
    out[np.asarray(found["_word"].combine_chunks())] = np.asarray(found["_bits"].combine_chunks())
    return out.tobytes()


def _runs(p: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins in both texts and lengths in words of the matches made by windows that follow each other on a diagonal."""
    cuts = np.flatnonzero((np.diff(p) != 1) | (np.diff(p - q) != 0)) + 1
    begin = np.concatenate([[0], cuts])
    return p[begin], q[begin], np.diff(np.concatenate([begin, [len(p)]])) + size - 1


def _tiles(places: np.ndarray, item_places: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the places where windows of `size` words match: (place, item place, words).

    Matches are sought with falling lengths, halved down to `size`. In each round the matches of unmarked words of that
    length or more are marked as tiles, the longest first, as long as no word of them was marked before; a match that lost words is
    found again in a later round, as what is left of it."""
    order = np.lexsort((places, places - item_places))
    p, q = places[order].astype(np.int64), item_places[order].astype(np.int64)
    a, b, n = _runs(p, q, size)
    if len(n) == 1:
        return [(int(a[0]), int(b[0]), int(n[0]))]
    low_p, low_q = p.min(), q.min()
    used_p, used_q = np.zeros(p.max() - low_p + size + 1, bool), np.zeros(q.max() - low_q + size + 1, bool)
    length = size << int(np.log2(n.max() / size))
    tiles = []
    while len(p):
        marked = False
        for k in np.argsort(-n, kind="stable"):
            if n[k] < length:
                break
            x, y = slice(a[k] - low_p, a[k] - low_p + n[k]), slice(b[k] - low_q, b[k] - low_q + n[k])
            if not used_p[x].any() and not used_q[y].any():
                used_p[x] = used_q[y] = marked = True
                tiles.append((int(a[k]), int(b[k]), int(n[k])))
        if not marked:
            if length == size:
                break
            length //= 2
        taken_p, taken_q = (np.concatenate([[0], np.cumsum(u)]) for u in (used_p, used_q))
        free = (taken_p[p - low_p + size] == taken_p[p - low_p]) & (taken_q[q - low_q + size] == taken_q[q - low_q])
        p, q = p[free], q[free]
        if len(p):
            a, b, n = _runs(p, q, size)
    return tiles


def _cover(size: int):
    """Rows come sorted by document and passage; each pair of them is tiled when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def tiled(t: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            ids, names = np.asarray(t["_id"].combine_chunks()), t["_k"].combine_chunks()
            code = np.asarray(names.dictionary_encode().indices)
            begin = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (code[1:] != code[:-1])]))
            end = np.concatenate([begin[1:], [len(t)]])
            left = None if last else t.slice(begin[-1])
            p, q = np.asarray(t["_p"].combine_chunks()), np.asarray(t["_q"].combine_chunks())
            out = []
            for b, e in list(zip(begin, end))[: len(begin) if last else -1]:
                n = [x[2] for x in _tiles(p[b:e], q[b:e], size)]
                out.append((int(ids[b]), names[int(b)].as_py(), len(n), max(n), sum(n)))
            return out, left

        def batch(out: list) -> pa.RecordBatch:
            columns = zip(*out)
            kinds = [("_id", pa.int64()), ("_k", pa.binary()), ("baldosas", pa.int32()), ("mas_larga", pa.int32()), ("palabras", pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                out, rest = tiled(t if rest is None else pa.concat_tables([rest, t]).combine_chunks(), False)
                if out:
                    yield batch(out)
        if rest is not None and len(rest):
            yield batch(tiled(rest, True)[0])

    return run


def leaks(documents: DataFrame, items: DataFrame, size: int = LEAST_WORDS) -> DataFrame:
    """Each document with each evaluation item of which it holds at least `size` words in a row.

    documents: _id (bigint), _text. items: _item (bigint), _passage. Out: _id, _item, baldosas (tiles),
    mas_larga (words of the longest), palabras (words tiled), largo (words of the passage),
    cobertura = palabras / largo. Repeated rows of an item count once, of several passages of one item the most
    covered stands; nulls and texts of fewer words than `size` give nothing.

    Passages of the same words are one class. Documents are scanned once and only windows that pass the sieve leave the
    scan: a bitmap sized by the passages' windows, at most 16 MB. These seeds meet the passages' windows by number, those of windows that
    many documents hold in SALTS parts, and are then compared as words, so no hash decides. The group of a
    document and a passage holds at most the windows of those two texts; it is tiled, and kept if its tiles cover `size`
    words. A tile has at least as many, so every pair with a common window is kept.
    """
    spark = documents.sparkSession
    kind = "_item bigint, _k binary, _words string, largo int"
    asked = items.where("_item is not null and _passage is not null").select("_item", "_passage").mapInArrow(_passages, kind)
    asked = cut(asked.where(F.col("largo") >= size).distinct())
    seeds = cut(asked.groupBy("_k").agg(F.min("_words").alias("_words")).mapInArrow(_seeds(size), "_k binary, _h bigint, _q int, _v string"))
    power = min(MOST_BITS, max(LEAST_BITS, BITS_A_WINDOW + int(seeds.count()).bit_length()))
    sieve = spark.sparkContext.broadcast(_sieve(seeds, power))
    texts = documents.where("_id is not null and _text is not null").select("_id", "_text")
    found = cut(texts.mapInArrow(_windows_of(size, power, sieve), "_id bigint, _h bigint, _p int, _w string"))
    often = F.broadcast(heavy_keys(found, "_h", found.count()).select("_h", F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).otherwise(0).alias("_part")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    ours = found.join(often, "_h", "left").select("_id", "_h", "_p", "_w", part)
    theirs = seeds.join(often, "_h", "left").select("_k", "_h", "_q", "_v", F.explode(parts).alias("_part"))
    pairs = ours.join(theirs, ["_h", "_part"]).where("_w = _v").select("_id", "_k", "_p", "_q").distinct()
    grouped = spread(pairs, "_id", "_k").sortWithinPartitions("_id", "_k")
    tiled = grouped.mapInArrow(_cover(size), "_id bigint, _k binary, baldosas int, mas_larga int, palabras int").where(F.col("palabras") >= size)
    named = join_checked(tiled, asked.select("_k", "_item", "largo"), "_k", "inner").withColumn("cobertura", F.col("palabras") / F.col("largo"))
    best = F.max(F.struct("cobertura", "palabras", "mas_larga", "baldosas", "largo")).alias("_b")
    return named.groupBy("_id", "_item").agg(best).select("_id", "_item", "_b.baldosas", "_b.mas_larga", "_b.palabras", "_b.largo", "_b.cobertura")
