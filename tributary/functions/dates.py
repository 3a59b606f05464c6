"""Date texts: which order a column uses, and the ISO text of each cell."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DMY, MDY, YMD, DMONY = "DMY", "MDY", "YMD", "DMonY"
AMBIGUOUS = "AMBIGUOUS"

_NUMERIC = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$"
_SHORT_YEAR = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2}$"
_ISO = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DAY_MONTH = rf"(?i)^(\d{{1,2}})[-/ ]({_MONTHS})[-/, ]+(\d{{4}})$"
_MONTH_DAY = rf"(?i)^({_MONTHS})[-/ ](\d{{1,2}})[-/, ]+(\d{{4}})$"
_MONTH_NAME = rf"(?i)^(\d{{1,2}}[-/ ]({_MONTHS})|({_MONTHS})[-/ ]\d{{1,2}})[-/, ]+\d{{4}}$"
# Two-digit years up to this one lie in the 2000s.
_LAST_SHORT_YEAR = 68


def parse(c: Column, order: str) -> Column:
    """DATE of a text read in one order; NULL when it does not fit."""
    if order == YMD:  # the day that is written, whatever the time zone
        return F.when(c.rlike(_ISO), F.translate(F.regexp_extract(c, r"^[\d/.-]+", 0), "/.", "--").try_cast("date"))
    if order == DMONY:
        day_first = c.rlike(_DAY_MONTH)

        def part(day_month: int, month_day: int) -> Column:
            return F.when(day_first, F.regexp_extract(c, _DAY_MONTH, day_month)).otherwise(F.regexp_extract(c, _MONTH_DAY, month_day))
        text = F.concat_ws("-", part(1, 2), F.initcap(F.left(part(2, 1), F.lit(3))), part(3, 3))
        return F.when(c.rlike(_MONTH_NAME), F.try_to_timestamp(text, F.lit("d-MMM-yyyy")).cast("date"))
    parts = F.split(F.translate(c, "/.", "--"), "-")
    day, month = (0, 1) if order == DMY else (1, 0)
    century = F.when(parts[2].try_cast("int") <= _LAST_SHORT_YEAR, "20").otherwise("19")
    year = F.when(F.length(parts[2]) == 2, F.concat(century, parts[2])).otherwise(parts[2])
    return F.when(c.rlike(_NUMERIC) | c.rlike(_SHORT_YEAR), F.concat_ws("-", year, parts[month], parts[day]).try_cast("date"))


def order_of_column(c: Column, times: Column | None = None) -> Column:
    """Aggregate: the date order of a whole column of non-blank texts, each there so many ``times`` (once).

    ISO and month-name cells speak for themselves and never decide the order
    of the numeric ones. A numeric column is settled by cells that fit only
    one order; if none does it is AMBIGUOUS, and so is a column in which both
    orders are proven.
    """
    dmy, mdy = parse(c, DMY).isNotNull(), parse(c, MDY).isNotNull()
    n_dmy, n_mdy = F.count_if(dmy & ~mdy), F.count_if(mdy & ~dmy)
    n_both = F.count_if(dmy & mdy)
    times = F.lit(1) if times is None else times
    n_month, n_iso = (F.coalesce(F.sum(F.when(c.rlike(shape), times)), F.lit(0)) for shape in (_MONTH_NAME, _ISO))
    return (
        F.when((n_dmy > 0) & (n_mdy > 0), AMBIGUOUS)
        .when(n_dmy > 0, DMY)
        .when(n_mdy > 0, MDY)
        .when(n_both > 0, AMBIGUOUS)
        .when(n_month > n_iso, DMONY)
        .when(n_iso > 0, YMD)
    )


def to_iso(c: Column, order: Column) -> Column:
    """ISO text of a cell, given the order of its column.

    Unreadable text is kept as it is. A numeric date in a column of unknown
    order is withheld (NULL); the landed row still holds the raw text.
    """
    numeric = c.rlike(_NUMERIC) | c.rlike(_SHORT_YEAR)
    read = F.coalesce(
        parse(c, YMD),
        parse(c, DMONY),
        F.when(order == DMY, parse(c, DMY)).when(order == MDY, parse(c, MDY)),
    )
    withheld = numeric & (F.coalesce(order, F.lit(AMBIGUOUS)) == AMBIGUOUS)
    return F.when(withheld, F.lit(None).cast("string")).otherwise(F.coalesce(F.date_format(read, "yyyy-MM-dd"), c))
