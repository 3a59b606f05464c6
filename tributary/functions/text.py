"""Cell cleaning as column expressions; everything stays inside Spark's codegen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Texts that mean "no value" (compared lower-cased and trimmed).
NULL_TOKENS = ("", "nan", "none", "null", "na", "n/a", "#n/a", "<na>")

BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def clean_sql(column: str) -> str:
    """SQL of the trimmed text of a column, NULL for a null token."""
    trimmed = f"trim(BOTH ' \\t\\n\\r\\u000b\\u000c' FROM CAST(`{column.replace('`', '``')}` AS STRING))"
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    return f"CASE WHEN lower({trimmed}) NOT IN ({tokens}) THEN {trimmed} END"


def clean(column: str) -> Column:
    """Trimmed text of a column, or NULL for a null token."""
    return F.expr(clean_sql(column))


def squeeze(c: Column) -> Column:
    """Trim, and turn each run of white space into one space."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def title(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others."""
    pieces = F.split(F.lower(c), r"(?<!\p{L})(?=\p{L})")
    raised = F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p))))
    return F.array_join(raised, "")


def name_case(c: Column) -> Column:
    """Title-case only names typed entirely in one case; mixed case is kept."""
    s = squeeze(c)
    return F.when((F.upper(s) == s) | (F.lower(s) == s), title(s)).otherwise(s)


def email(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))


def split_full_name(c: Column) -> tuple[Column, Column]:
    """(first, last): the first token and the rest; a single token has an empty last name."""
    s = squeeze(c)
    cut = F.instr(s, " ")
    first = F.when(cut > 0, F.left(s, cut - 1)).otherwise(s)
    last = F.when(cut > 0, F.substring(s, cut + 1, F.length(s))).otherwise(F.lit(""))
    return title(first), title(last)


@dataclass(frozen=True)
class PhoneRegion:
    """How national numbers of a region look: country code, trunk prefix, digits."""

    code: str
    country: str
    trunk: str
    national: str


# Country codes, trunk prefixes and national number shapes.
PHONE_REGIONS = (
    PhoneRegion("IN", "91", "0", r"[1-9]\d{9}"),
    PhoneRegion("US", "1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    PhoneRegion("GB", "44", "0", r"[1-9]\d{8,9}"),
    PhoneRegion("DE", "49", "0", r"[1-9]\d{5,12}"),
    PhoneRegion("FR", "33", "0", r"[1-9]\d{8}"),
    PhoneRegion("AE", "971", "0", r"[1-9]\d{7,8}"),
    PhoneRegion("SG", "65", "", r"[3689]\d{7}"),
    PhoneRegion("AU", "61", "0", r"[1-9]\d{8}"),
)


def phone_e164(c: Column, default_region: str = "IN",
               regions: tuple[PhoneRegion, ...] = PHONE_REGIONS) -> Column:
    """E.164 when the number fits a region rule, otherwise just its digits and plus."""
    home = next(r for r in regions if r.code == default_region)
    digits = F.regexp_replace(c, r"[^\d+]", "")
    out = F.when(digits == "", F.lit(None).cast("string"))
    for r in regions:
        out = out.when(digits.rlike(rf"^\+{r.country}{_trunk(r)}{r.national}$"),
                       F.concat(F.lit("+" + r.country), _national(digits, rf"^\+{r.country}{_trunk(r)}")))
    out = out.when(digits.rlike(rf"^{_trunk(home)}{home.national}$"),
                   F.concat(F.lit("+" + home.country), _national(digits, rf"^{_trunk(home)}")))
    out = out.when(digits.rlike(rf"^(00)?{home.country}{home.national}$"),
                   F.concat(F.lit("+" + home.country), _national(digits, rf"^(00)?{home.country}")))
    return out.otherwise(digits)


def _trunk(r: PhoneRegion) -> str:
    return f"(?:{r.trunk})?" if r.trunk else ""


def _national(digits: Column, prefix: str) -> Column:
    return F.regexp_replace(digits, prefix, "")


def decimal_text(c: Column) -> Column:
    """The text of a number with thousands commas and dollar signs removed."""
    return F.regexp_replace(c, r"[,$]", "")


def to_number(c: Column) -> Column:
    """The value as a double, or NULL when it is not a number."""
    t = decimal_text(c)
    return F.when(~t.rlike("[dDfF]\\s*$"), t.try_cast("double"))
