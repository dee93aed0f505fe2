"""Parsing of ids, dates, visit sequences and diagnoses that come as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
INVALID = ["", "NaN", "nan", "<missing>", "missing", "없음", "진단중"]


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("long")


def valid_text(c: Column) -> Column:
    """Whether a text is there and doesn't stand for a missing value."""
    return F.coalesce(~F.trim(c).isin(INVALID), F.lit(False))


def last_number(c: Column) -> Column:
    """The last run of digits as a number: 'AB-0012-345' gives 345."""
    return _number(F.try_element_at(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)))


def leading_number(c: Column) -> Column:
    """The digits that a text begins with, else the whole text as a number."""
    return F.coalesce(_number(F.regexp_extract(c, r"^(\d+)", 1)), F.trim(c).try_cast("long"))


# The patterns of ids, visits and sequences and the words of diagnoses below are fixed values of the input format.


def visit_number(c: Column) -> Column:
    """The second of two numbers with a hyphen between: '12-3' gives 3."""
    return _number(F.regexp_extract(c, r"(\d+)-(\d+)", 2)).cast("int")


def year_month(c: Column) -> Column:
    """A date text as YYYYMM: a full date in some common form, else the first year and month or six digits anywhere in it."""
    t = F.trim(c)
    day = F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd")])
    parts, six = r"(\d{4})[-/.](\d{1,2})", r"(\d{6})"  # fixed values: forms of dates
    loose = _number(F.regexp_extract(t, parts, 1)) * 100 + _number(F.regexp_extract(t, parts, 2))
    return F.coalesce(F.year(day) * 100 + F.month(day), loose, _number(F.regexp_extract(t, six, 1))).cast("int")


def month_distance(a: Column, b: Column) -> Column:
    """Months from b to a, both as YYYYMM; signed."""
    return ((F.floor(a / 100) - F.floor(b / 100)) * 12 + (a % 100 - b % 100)).cast("int")


def _sequence(c: Column, pattern: str, value: str, kind: str) -> Column:
    visits = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(visits.alias("v"), values.alias("x")), lambda e, i: F.struct((i + 1).alias("seq"), e["v"].try_cast("int").alias("visit"), F.trim(e["x"]).try_cast(kind).alias(value)))


def parse_dates(c: Column) -> Column:
    """'1차 : 201703, 2차 : 201808' as an array of (seq, visit, yyyymm); entries without six digits are left out."""
    return _sequence(c, r"(\d+)\s*차\s*:\s*(\d{6})", "yyyymm", "int")


def parse_diagnoses(c: Column) -> Column:
    """'1차 : CN, 2차 : MCI' as an array of (seq, visit, dx); a comma, semicolon or slash ends a value."""
    return _sequence(c, r"(\d+)\s*차\s*:\s*([^,;/]+)", "dx", "string")


def _has(x: Column, *parts: str) -> Column:
    out = x.contains(parts[0])
    for p in parts[1:]:
        out = out | x.contains(p)
    return out


def strict_diagnosis(c: Column) -> Column:
    """CN, SCD, MCI, DEM/D, NOS or Unknown by the strict rules."""
    x = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when((x == "") | _has(x, "진단중", "없음", "UNKNOWN", "NAN", "MISSING"), "Unknown")
        .when((x == "CN") | _has(x, "NORMAL"), "CN")
        .when(x == "SCD", "SCD")
        .when(_has(x, "MCI"), "MCI")
        .when(x.isin("AD", "D", "DEM") | _has(x, "DEMENTIA", "DEM/D", "AD/D"), "DEM/D")
        .when(x == "NOS", "NOS")
        .otherwise("Unknown")
    )


def loose_diagnosis(c: Column) -> Column:
    """CN, SCD, MCI, DEM/D or Unknown: NOS is unknown, anything with DEM is DEM/D."""
    x = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when((x == "") | _has(x, "진단중", "UNKNOWN", "NOS"), "Unknown")
        .when(x.isin("CN", "SCD"), x)
        .when(_has(x, "MCI"), "MCI")
        .when(x.isin("AD", "D") | _has(x, "DEM", "AD/D"), "DEM/D")
        .otherwise("Unknown")
    )


def file_key(c: Column) -> Column:
    """'ID12-2018y-07m_17d_9h_5m.TXT' as 'id12_20180717_0905'; other names in lower case, without spaces, endings and suffixes."""
    x = F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit(".txt"), F.lit("")), r"\s+", "")
    # fixed values: the forms of file names and the suffixes that don't count
    p = r"(id\d+)-(\d{4})y-(\d{2})m_(\d{2})d_(\d{1,2})h_(\d{1,2})m"
    suffixes = [(r"(_[a-z]_raw|_raw|-raw)$", ""), (r"\([^)]*\)", ""), (r"_(\d{1,2})h_(\d{1,2})m_\d{1,2}s", "_$1h_$2m"), (r"_+$", "")]
    two = lambda i: F.lpad(F.regexp_extract(x, p, i), 2, "0")
    dated = F.concat(F.regexp_extract(x, p, 1), F.lit("_"), F.regexp_extract(x, p, 2), two(3), two(4), F.lit("_"), two(5), two(6))
    plain = x
    for old, new in suffixes:
        plain = F.regexp_replace(plain, old, new)
    return F.when(x.rlike(p), dated).otherwise(plain)


def split_list(c: Column, by: str = ",") -> Column:
    """Parts of a text list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")


def join_list(c: Column, by: str = ",") -> Column:
    return F.array_join(c, by)
