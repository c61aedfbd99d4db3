"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.operators.cut import cut
from quipu.operators.skew import heavy_keys, join_with_heavy

#: Single characters that part values wherever they stand outside a quotation.
MARKS = [",", ";", "|", "\n", "\t", "•", "·", "，", "、", "；"]
#: Slash and hyphen part values only with blanks around them.
BLANKED = ["/", "-"]
WRAPPERS = {"[": "]", "{": "}"}
DOUBLE = r'"(?:[^"\\]|\\.|"")*"'
SINGLE = r"'(?:[^'\\]|\\.|'')*'"
TRIM = r"^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$"
#: Characters of all rules together up to which these are broadcast, counted before; beyond it they are joined.
BROADCAST_CHARS = 16_000_000

_SIGNS = r"""\[\]{}"'\\/\-""" + "".join("\\" + m if m == "|" else m for m in MARKS)
#: A field falls into pieces: a run of ordinary characters, a run of blanks, or one character that means something.
ORDINARY, BLANKS = rf"[^\s{_SIGNS}]+", r"[\s&&[^\n\t]]+"
PIECE = rf"{ORDINARY}|{BLANKS}|(?s:.)"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def skeleton(value: Column) -> Column:
    """The trimmed value with its runs of ordinary characters masked as x and its runs of blanks as one: a character a piece."""
    return F.regexp_replace(F.regexp_replace(trimmed(value), ORDINARY, "x"), BLANKS, " ")


def splitting_rule(text: str) -> tuple[bool, list[tuple[int, int]]]:
    """From a skeleton: whether single quotes quote, and each value's first piece (from 1) and its number of pieces.

    Brackets around all are left out. Single quotes quote only in a bracket that opens with one. What parts values
    is what occurs outside quotations."""
    wrapped = len(text) > 1 and WRAPPERS.get(text[0]) == text[-1]
    single = wrapped and text[1:].lstrip().startswith("'")
    bare = re.sub(DOUBLE, "Q", text, flags=re.S)
    if single:
        bare = re.sub(SINGLE, "Q", bare, flags=re.S)
    plain = "".join(re.escape(m) for m in MARKS if m in bare)
    shut = [f"[{plain}]"] * bool(plain)
    also, free = "", plain
    if re.search(r"(?:^|\s)/|/(?:\s|$)", bare):
        free, also = free + "/", also + r"|(?<=\S)/(?=\S)"
        shut.append(r"\s/|/\s")
    if re.search(r"(?:^|\s)-(?:\s|$)", bare):
        free, also = free + r"\-", also + r"|-(?=\S)|(?<=\S)-"
        shut.append(r"-\s")
    run = f"(?:[^{free}]{also})+" if free else r"(?s:.)+"
    end = "(?=\\s*(?:" + "|".join([*shut, r"\Z"]) + "))"
    quoted = [DOUBLE + end] * ('"' in text) + [SINGLE + end] * single
    value = re.compile("|".join([*(rf"\s*{q}" for q in quoted), run]), re.S)
    body, skipped = (text[1:-1], 1) if wrapped else (text, 0)
    return single, [(m.start() + skipped + 1, m.end() - m.start()) for m in value.finditer(body) if m.group().strip()]


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [splitting_rule(s) for s in b["_esqueleto"]]
        spans = [[{"b": b_, "n": n} for b_, n in g[1]] for g in got]
        yield pd.DataFrame({"_esqueleto": b["_esqueleto"], "_simple": [g[0] for g in got], "_tramos": spans})


def _unquoted(v: Column) -> Column:
    """A trimmed value without its quotes."""
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    is_double = F.length(v).__ge__(2) & v.startswith('"') & v.endswith('"')
    is_single = F.length(v).__ge__(2) & v.startswith("'") & v.endswith("'")
    backslash = F.contains(v, F.lit("\\"))
    simple = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    by_json = F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0))
    double = F.when(backslash, F.coalesce(by_json, simple(inner))).otherwise(F.replace(inner, F.lit('""'), F.lit('"')))
    single = F.when(backslash, simple(inner)).otherwise(F.replace(inner, F.lit("''"), F.lit("'")))
    return F.when(is_double, trimmed(double)).when(is_single, trimmed(single)).otherwise(v)


def unpack(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per value of the packed field `column`, with the columns of `keep`.

    Out: keep, posicion (int, from 1, empty values don't count, repeats do), valor. Other
    columns of rows are ignored, whatever their names; keep may not hold posicion or valor. Delimiters may differ between rows and within one; a quotation is one value with
    its doubled or escaped characters resolved; enclosing quotes, brackets, list marks and
    outer blanks go. Null, empty and delimiter-only fields give no row.

    The skeleton of a field says where its values lie among its pieces. This is resolved once per distinct skeleton; the
    rules are broadcast as long as they are short altogether, and the fields cut by position. Fields of ever new shapes
    make many rules: these are joined by skeleton, those of frequent skeletons where the rows lie.
    """
    named = [F.col(f"`{c}`") for c in keep]
    marked = rows.where(F.col(f"`{column}`").isNotNull()).select(*named, trimmed(F.col(f"`{column}`")).alias("_campo")).where("_campo <> ''")
    marked = marked.withColumn("_esqueleto", skeleton(F.col("_campo")))
    shapes = cut(marked.groupBy("_esqueleto").agg(F.count(F.lit(1)).alias("_n")))
    size = shapes.agg(F.sum(F.length("_esqueleto")).alias("chars"), F.sum("_n").alias("rows")).first()
    rules = shapes.select("_esqueleto").mapInPandas(_rules, "_esqueleto string, _simple boolean, _tramos array<struct<b: int, n: int>>")
    if (size["chars"] or 0) <= BROADCAST_CHARS:
        ruled = marked.join(F.broadcast(rules), "_esqueleto")
    else:
        ruled = join_with_heavy(marked, cut(rules), "_esqueleto", heavy_keys(marked, "_esqueleto", size["rows"]))
    cutout = ruled.select(*named, "_simple", "_tramos", F.regexp_extract_all("_campo", F.lit(PIECE), F.lit(0)).alias("_piezas"))
    raw = F.transform(F.transform("_tramos", lambda t: F.array_join(F.slice("_piezas", t["b"], t["n"]), "")), trimmed)
    # an unwrapped single-quoted value keeps its quotes: there an apostrophe is a letter
    keeps = lambda x: F.when(F.col("_simple") | x.startswith('"'), _unquoted(x)).otherwise(x)
    values = F.filter(F.transform(raw, keeps), lambda x: x != "")
    split = cutout.select(*named, F.posexplode(values).alias("_p", "valor"))
    return split.withColumn("posicion", (F.col("_p") + 1).cast("int")).drop("_p")
