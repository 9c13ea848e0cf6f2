"""Dates of any writing as columns: days, ages and the conventions of a column."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip
from .vocab import EPOCH_TEXTS, MONTHS, NO_DATE

_THREE = r"^(\d{1,4})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1,4})"
PROVEN, GUESSED, MIXED = "proven", "guessed", "mixed"


def conventions(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column its order of day and month, place of the year, and how sure that is.

    A value with a first group over 12 proves day first, with a second over 12 month
    first; a first group over 31 the year first, a third of two digits over 31 the year
    last. Both kinds of proof in a column make it mixed; none, guessed (day first)."""
    aggs = []
    for c in columns:
        t = strip(F.col(c))
        a, b, d = (F.regexp_extract(t, _THREE, k).try_cast("int") for k in (1, 2, 3))
        short = F.length(F.regexp_extract(t, _THREE, 3)) == 2
        ambiguous = F.length(F.regexp_extract(t, _THREE, 1)) <= 2
        df_ = F.count_if(ambiguous & (a > 12))
        mf = F.count_if(ambiguous & (a <= 12) & (b > 12))
        yf, yl = F.count_if(ambiguous & (a > 31)), F.count_if(ambiguous & (a <= 31) & short & (d > 31))
        status = F.when(((df_ > 0) & (mf > 0)) | ((yf > 0) & (yl > 0)), MIXED).when(((df_ == 0) & (mf == 0)) | ((yf == 0) & (yl == 0)), GUESSED).otherwise(PROVEN)
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), df_.alias("day_first_proofs"), mf.alias("month_first_proofs"), yf.alias("year_first_proofs"), yl.alias("year_last_proofs"),
            F.when((df_ == 0) & (mf == 0), True).otherwise(df_ >= mf).alias("day_first"), F.when((yf == 0) & (yl == 0), False).otherwise((yf > 0) & (yf >= yl)).alias("year_first"), status.alias("convention"),
        ))
    return df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


# A time of day, a zone after it, and what may follow a date: a time with its zone, or an offset.
_TIME = r"(?:(?:[01]?\d|2[0-3])[:.][0-5]\d(?:[:.](?:[0-5]\d|60)(?:[.,]\d+)?)?\s*(?:[ap]\.?m\.?)?|\d{1,2}\s*[ap]\.?m\.?)"
_ZONE = r"\s*(?:z|[a-z]{3,4})?\s*(?:[+-]\d{1,2}(?::?\d{2}(?::?\d{2})?)?)?\s*(?:\([a-z0-9+-]{2,7}\))?"
_REST = rf"(?:(?:t|[\s,]\s*){_TIME}{_ZONE}|\s*[+-]\d{{1,2}}:?\d{{2}}|z)?$"


def _q(pattern: str) -> str:
    """A pattern as a SQL literal without escapes."""
    return "r'" + pattern + "'"


def _words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _day(y: str, m: str, d: str) -> str:
    return f"cast(try_to_timestamp(concat_ws('-', {y}, {m}, {d}), 'y-M-d') as date)"


def _year(y: str, ref: date) -> str:
    """A year of two digits within fifty years of the reference; longer ones as they are."""
    near = f"({ref.year // 100 * 100} + try_cast({y} as int))"
    return f"if(length({y}) > 2, try_cast({y} as int), {near} + case when {near} >= {ref.year + 50} then -100 when {near} < {ref.year - 50} then 100 else 0 end)"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with a value under a name, computed once for each row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_MONTH_OF = "map(" + ", ".join(f"'{w}', {m}" for m, words in MONTHS.items() for w in words) + ")"


def day_sql(c: str, ref: date, day_first: bool = True, year_first: bool = False, convention: str = PROVEN) -> str:
    """SQL of the date that a text (a SQL expression) names, null if none can be told; offsets are dropped, not applied.

    A date is told only by a whole value: after it, nothing but a time, its zone or an
    offset may stand. Without a year, it is the latest such day up to the reference."""
    got = lambda pattern, k: f"regexp_extract(w, {_q(pattern)}, {k})"
    when = lambda pattern, then: f"case when w rlike {_q(pattern)} then {then} end"
    parts = lambda pattern, y, m, d: when(pattern, _day(got(pattern, y), got(pattern, m), got(pattern, d)))

    three = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_REST}"
    by_day, by_month = _day(_year("p.c", ref), "p.b", "p.a"), _day(_year("p.c", ref), "p.a", "p.b")
    by_year = _day(_year("cast(p.a as string)", ref), "p.b", "p.c")
    told = f"case when p.a > 12 then {by_day} when p.b > 12 then {by_month} else {by_day if day_first else by_month} end"
    told = f"if(length(p.c) = 2 and (p.a > 31 or {'true' if year_first else 'false'}), {by_year}, {told})"
    if convention == MIXED:
        told = f"if(p.a <= 12 and p.b <= 12, null, {told})"
    numbers = f"struct(try_cast({got(three, 1)} as int) as a, try_cast({got(three, 2)} as int) as b, {got(three, 3)} as c)"

    # with a month's name: all patterns to one struct of year, name and day, so that names are looked up once
    named = [
        (rf"^(\d{{1,2}})[-/. ]?\s*(\p{{L}}+)\.?[-/., ]?\s*(\d{{4}}|\d{{2}}){_REST}", 3, 2, 1),
        (rf"^(\p{{L}}+)\.?[-/ ]\s*(\d{{1,2}})(?:,|[-/]|,?\s)\s*(\d{{4}}){_REST}", 3, 1, 2),
        (rf"^(\d{{4}})[-/. ]?\s*(\p{{L}}+)\.?[-/., ]?\s*(\d{{1,2}}){_REST}", 1, 2, 3),
        (rf"^(\p{{L}}+)\s+(\d{{1,2}})\s+{_TIME}\s+(?:[+-]\d{{4}}\s+|[a-z]{{3,4}}\s+)?(\d{{4}})$", 3, 1, 2),
        (r"^(\p{L}+)\.?[-/ ]?\s*(\d{4})$", 2, 1, None),
        (rf"^(\p{{L}}+)\.?\s+(\d{{1,2}})(?:,?\s+{_TIME}{_ZONE})?$", None, 1, 2),
        (rf"^(\d{{1,2}})[-/. ]\s*(\p{{L}}+)\.?(?:,?\s+{_TIME}{_ZONE})?$", None, 2, 1),
    ]
    spell = "case " + " ".join(f"when w rlike {_q(x)} then struct({got(x, y) if y else repr('')} as y, {got(x, m)} as m, {got(x, d) if d else repr('1')} as d)" for x, y, m, d in named) + " end"
    no_year = f"array_max(filter(transform(sequence(0, 8), k -> {_day(f'{ref.year} - k', 'v.m', 'v.d')}), x -> x <= date'{ref}'))"
    looked = _let(f"struct(s.y as y, try_element_at({_MONTH_OF}, s.m) as m, s.d as d)", "v", f"case when v.m is null then null when v.y = '' then {no_year} else {_day(_year('v.y', ref), 'v.m', 'v.d')} end")
    texts = [
        parts(r"^(\d{4})(\d{2})(\d{2})\d{6}(\.\d+)?(z|[+-]\d{4})$", 1, 2, 3), parts(rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_REST}", 1, 2, 3),
        when(three, _let(numbers, "p", told)),
        when(r"^(\d{4})[-/](\d{1,2})$", _day(got(r"^(\d{4})[-/](\d{1,2})$", 1), got(r"^(\d{4})[-/](\d{1,2})$", 2), "1")),
        when(r"^(\d{1,2})[-/](\d{4})$", _day(got(r"^(\d{1,2})[-/](\d{4})$", 2), got(r"^(\d{1,2})[-/](\d{4})$", 1), "1")),
        f"case when w rlike {_q(chr(92) + 'p{L}')} then {_let(spell, 's', looked)} end",
    ]
    plain = r"regexp_replace(regexp_replace(lower(t), r'\b(\d{1,2})(st|nd|rd|th)\b', '$1'), r'^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+', '')"
    written = _let(plain, "w", "coalesce(" + ", ".join(texts) + ")")

    # serial days, epoch seconds or milliseconds, hundreds of nanoseconds since 1601, or YYYYMMDD
    whole = r"regexp_extract(t, r'^(\d+)', 1)"
    number = f"""case when n between 32874 and 73050 then date_add(date'1899-12-30', cast(floor(n) as int))
      when n >= 1e9 and n < 1e10 then cast(timestamp_seconds(cast(floor(n) as bigint)) as date)
      when n >= 1e12 and n < 1e13 then cast(timestamp_millis(cast(floor(n) as bigint)) as date)
      when n > 1e14 and n < 9e18 then cast(timestamp_micros(cast(floor(n / 10) - 11644473600000000 as bigint)) as date)
      when length({whole}) = 8 and n between 19000101 and 21001232 then {_day(f'substring({whole}, 1, 4)', f'substring({whole}, 5, 2)', f'substring({whole}, 7, 2)')} end"""
    refused = rf"t rlike r'^\d{{1,2}}\s+\d{{1,2}}:\d{{2}}:\d{{2}}\s+[+-]\d{{4}}\s+\d{{4}}$' or t rlike r'^\d{{1,4}}\s*,\s*\d{{1,4}}\s*,\s*\d{{1,4}}$' or lower(t) in {_words(EPOCH_TEXTS)} or t like '1970-01-01%'"
    body = rf"""case when t is null or lower(t) in {_words(NO_DATE)} then null when t rlike r'^\d+(\.\d+)?$' then {_let('try_cast(t as double)', 'n', number)}
      when {refused} then null else {written} end"""
    return _let(rf"regexp_replace(cast({c} as string), r'(?U)^\s+|\s+$', '')", "t", body)


def day_of(c: str, ref: date, **how) -> Column:
    """``day_sql`` as a column; ``c``: a SQL expression, such as a column's name."""
    return F.expr(day_sql(c, ref, **how))


def moment_of(c: str, ref: date, **how) -> Column:
    """struct(day, seconds): the date in a text with the time of day in it, if any; null if there is no date."""
    time = r"([01]?\d|2[0-3])[:.]([0-5]\d)(?:[:.]([0-5]\d))?(?:[.,]\d+)?\s*([ap])?"
    at = lambda k: f"regexp_extract(lower(cast({c} as string)), {_q(r'(?:t|[ ,])' + time)}, {k})"
    hour = f"(coalesce(try_cast({at(1)} as int), 0) % if({at(4)} = '', 24, 12) + if({at(4)} = 'p', 12, 0))"
    seconds = f"{hour} * 3600 + coalesce(try_cast({at(2)} as int), 0) * 60 + coalesce(try_cast({at(3)} as int), 0)"
    return F.expr(f"get(filter(array(struct({day_sql(c, ref, **how)} as day, {seconds} as seconds)), x -> x.day is not null), 0)")


def age_days(c: str, ref: date, **how) -> Column:
    """Whole days from the date in a text to the reference date; null if there is none."""
    return F.expr(f"datediff(date'{ref}', {day_sql(c, ref, **how)})")


def quarter_label(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))


def extraction_day(text: str | None, default: date) -> date:
    """The day on which an export was made, as a user writes it in one of four ways; else the default."""
    from datetime import datetime

    for pattern in ("%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y", "%d.%m.%Y"):
        try:
            return datetime.strptime((text or "").strip(), pattern).date()
        except ValueError:
            continue
    return default
