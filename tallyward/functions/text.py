"""Normalised text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM = "àáâãäåāçćčèéêëēęěìíîïīłñńòóôõöøōùúûüūýÿžźżšśğşıÀÁÂÃÄÅÇĆČÈÉÊËĘÌÍÎÏŁÑŃÒÓÔÕÖØÙÚÛÜÝŽŹŻŠŚĞŞİ"
_TO = "aaaaaaaccceeeeeeeiiiiilnnooooooouuuuuyyzzzssgsiAAAAAACCCEEEEEIIIILNNOOOOOOUUUUYZZZSSGSI"


def let(value, use) -> Column:
    """``use`` of a value that is computed once for each row; also keeps generated code small."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def low(c) -> Column:
    return F.lower(strip(c))


def fold(c) -> Column:
    """Letters without accents; what has no ASCII form goes."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"[^\x00-\x7F]", "")


def blank(c) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def present(c) -> Column:
    """The text, or null where it is blank."""
    return F.when(~blank(c), c)


def header_key(c) -> Column:
    return F.translate(low(c), "_-/", "   ")


def status_key(c) -> Column:
    """Signed integers in canonical form, other text as ASCII words."""
    t = low(c)
    return F.when(t.rlike(r"^[+-]?\d{1,18}$"), F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")).otherwise(F.trim(F.regexp_replace(fold(t), r"[^a-z0-9]+", " ")))


def status_words(c) -> Column:
    """Words of a status; a signed integer is one word with its sign."""
    t = low(c)
    whole = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(t.rlike(r"^[+-]?\d+$"), F.array(whole)).otherwise(F.array_remove(F.split(t, r"[^a-z0-9]+"), ""))


def any_of(c, words: list[str]) -> Column:
    return F.coalesce(c.isin(words), F.lit(False))


def overlaps(words: Column, among: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, among))), F.lit(False))


def cells(c) -> Column:
    """Parts of a multi-valued cell: by line, else by semicolon, else by comma; blanks go."""
    parts = F.when(F.contains(c, F.lit("\n")), F.split(c, "\n")).when(F.contains(c, F.lit(";")), F.split(c, ";")).otherwise(F.split(c, ","))
    return F.coalesce(F.filter(F.transform(parts, strip), lambda x: x != ""), F.array().cast("array<string>"))


def name_bag(c) -> Column:
    """Words of a name in ASCII, sorted: equal for the same words in any order."""
    joined = F.regexp_replace(F.lower(fold(F.regexp_replace(c, "’", "'"))), r"\b([a-z])'", "$1")
    return F.array_join(F.array_sort(F.regexp_extract_all(joined, F.lit(r"[a-z]+"), F.lit(0))), " ")


def without_controls(c) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def as_flag(c, false_words: list[str]) -> Column:
    """True unless null or one of the words for false."""
    return F.coalesce(~low(c.cast("string")).isin(false_words), F.lit(False))


def signed(c) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), c.cast("string"))
