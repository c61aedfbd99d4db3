"""Tokenizers and set similarities as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short technical words that count as tokens, and control words that don't.
SHORT_GRAPH = ["dsl", "api", "mcp", "rag", "cpu", "ram", "gpu", "cli", "db", "ui", "ux", "os", "ai", "vm"]
SHORT_PMI = ["dsl", "api", "mcp", "rag", "cpu", "ram", "gpu", "cli", "sql", "orm"]
CONTROL = ["nodo", "prueba", "test", "recuerdo", "concepto", "contenido", "sistema", "memoria", "node", "system", "memory", "concept", "content"]
ACCENTED, PLAIN = "áéíóúüñàèìòùâêîôûãõç", "aeiouunaeiouaeiouaoc"


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: str | Column, least: int = 1) -> Column:
    """Runs of letters, digits and _ of at least `least` characters, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0))


def spaced(c: str | Column) -> Column:
    """Lower-cased, with _ and - as blanks."""
    return F.translate(F.lower(text(c)), "_-", "  ")


def folded(c: str | Column) -> Column:
    """Lower-cased without the accents of Spanish and Portuguese, _ and - as blanks."""
    return F.translate(spaced(c), ACCENTED, PLAIN)


def without(tokens: Column, stop: list[str]) -> Column:
    return F.array_except(tokens, F.array(*map(F.lit, stop))) if stop else F.array_distinct(tokens)


def graph_tokens(c: str | Column, stop: list[str] = CONTROL) -> Column:
    """T1, a set: words of four or more letters and short technical words, without stop words."""
    flat = F.translate(F.lower(text(c)), "_", " ")
    long = F.regexp_extract_all(flat, F.lit(r"(?<![\p{L}\p{N}])[a-záéíóúñ]{4,}(?![\p{L}\p{N}])"), F.lit(0))
    short = F.array_intersect(F.regexp_extract_all(flat, F.lit(r"(?<![\p{L}\p{N}])[a-z]{2,3}(?![\p{L}\p{N}])"), F.lit(0)), F.array(*map(F.lit, SHORT_GRAPH)))
    return without(F.array_union(long, short), stop)


def pmi_tokens(c: str | Column, stop: list[str] = CONTROL) -> Column:
    """T2, a list in order with repeats: words of three or more letters, then short technical words."""
    flat = spaced(c)
    long = F.regexp_extract_all(flat, F.lit(r"(?<![\p{L}\p{N}])[a-záéíóúñ]{3,}(?![\p{L}\p{N}])"), F.lit(0))
    short = F.filter(F.split(flat, r"\s+"), lambda x: x.isin(SHORT_PMI))
    return F.filter(F.concat(long, short), lambda x: ~x.isin(stop)) if stop else F.concat(long, short)


def vector_tokens(c: str | Column) -> Column:
    """T3: as T2, but memoria, buscar and memory stay."""
    return pmi_tokens(c, [s for s in CONTROL if s not in ("memoria", "buscar", "memory")])


def teleological_tokens(c: str | Column) -> Column:
    """T3b: as T3, and sistema and dato stay too."""
    return pmi_tokens(c, [s for s in CONTROL if s not in ("memoria", "buscar", "memory", "sistema", "dato")])


def folded_tokens(c: str | Column) -> Column:
    """T4, a set: words of two or more characters without accents."""
    return F.array_distinct(F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))


def letter_tokens(c: str | Column, stop: list[str] | None = None) -> Column:
    """T5, a set: three or more letters, _ as a blank; a stop list for queries, none for contents."""
    return without(F.regexp_extract_all(F.translate(F.lower(text(c)), "_", " "), F.lit(r"[\p{L}]{3,}"), F.lit(0)), stop or [])


def phrase_tokens(c: str | Column, stop: list[str] | None = None) -> Column:
    """T6, in order: blank-parted words of two or more characters as they stand, without punctuation."""
    parts = F.filter(F.split(F.regexp_replace(text(c), r"[^\p{L}\p{N}_\s-]", " "), r"\s+"), lambda x: F.length(x) >= 2)
    return F.filter(parts, lambda x: ~folded(x).isin(stop)) if stop else parts


def trigrams(c: str | Column) -> Column:
    """T8, a set: three-character windows of [a-z0-9]; a shorter text is its own only one."""
    s = F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(s) >= 3, F.array_distinct(grams)).otherwise(F.array(s))


def hub_tokens(c: str | Column) -> Column:
    """T9, a set: two or more characters, no stop words, _ inside words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))


def blank_tokens(c: str | Column) -> Column:
    """T10, a set: what blanks part."""
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), r"\s+"), lambda x: x != ""))


def cluster_tokens(c: str | Column, stop: list[str] = CONTROL) -> Column:
    """T11, a list with repeats: words of three or more characters without stop words."""
    return F.filter(words(c, 3), lambda x: ~x.isin(stop)) if stop else words(c, 3)


def csv(c: str | Column) -> Column:
    """Comma-separated values, trimmed, without empty ones, repeats kept."""
    return F.filter(F.transform(F.split(text(c), ","), F.trim), lambda x: x != "")


def whole_word(token: Column, c: str | Column) -> Column:
    """PALABRA_COMPLETA: the token is a whole word of the text; null or empty gives false."""
    return F.coalesce((F.length(token) > 0) & F.array_contains(F.regexp_extract_all(spaced(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower(token)), F.lit(False))


def word_prefix(token: Column, c: str | Column) -> Column:
    """PALABRA_PREFIJO: some word of the text begins with the token; null or empty gives false."""
    ws = F.regexp_extract_all(spaced(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.coalesce((F.length(token) > 0) & F.exists(ws, lambda w: w.startswith(F.lower(token))), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens by the size of the smaller set."""
    return ratio(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def coverage(asked: Column, held: Column) -> Column:
    """Part of the asked tokens that are held."""
    return ratio(F.size(F.array_intersect(asked, held)), F.size(F.array_distinct(asked)))


def preview(c: str | Column, most: int) -> Column:
    return F.when(F.length(text(c)) > most, F.concat(F.substring(text(c), 1, most), F.lit("..."))).otherwise(text(c))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance by the longer length."""
    return F.lit(1.0) - ratio(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def half_up(x: Column, places: int) -> Column:
    """Rounding that other engines repeat exactly: floor(x * 10^p + 0.5) / 10^p."""
    p = float(10**places)
    return F.floor(x * p + 0.5).cast("double") / p
