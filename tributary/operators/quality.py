"""Record checks, safe repairs, and the valid / quarantined split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.contract import Contract
from tributary.functions import text
from tributary.operators.skew import count_keys, hot_keys, salted_join
from tributary.session import materialize

# Fixed value: what a valid e-mail looks like.
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
E164_SHAPE = r"^\+\d{6,15}$"
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}$"


def _present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def error_list(contract: Contract, value=F.col, *, check_dates: bool = False, check_phones: bool = False,
               excused_enums: Column | None = None) -> Column:
    """The failed checks of a record, as ``check:field`` texts in a fixed order.

    Order: required, e-mail shape, declared pattern, numbers, enums, then the
    optional date and phone shapes. ``value`` maps a field name to its column;
    ``excused_enums`` is an array of fields whose enum value is already under
    review and is not reported again.
    """
    checks: list[Column] = []

    def check(failed: Column, name: str) -> None:
        checks.append(F.when(failed, F.lit(name)))

    for f in contract.required:
        check(~_present(value(f.name)) | value(f.name).isNull(), f"required:{f.name}")
    for f in contract.of_type("email"):
        check(_present(value(f.name)) & ~value(f.name).rlike(EMAIL_SHAPE), f"email:{f.name}")
    for f in contract.fields:
        if f.pattern:
            check(_present(value(f.name)) & ~F.trim(value(f.name)).rlike(f.anchored_pattern), f"pattern:{f.name}")
    for f in contract.of_type("decimal"):
        number = text.to_number(value(f.name))
        check(_present(value(f.name)) & number.isNull(), f"number:{f.name}")
        if f.min is not None:
            check(number < f.min, f"minimum:{f.name}")
        if f.max is not None:
            check(number > f.max, f"maximum:{f.name}")
    for f in contract.of_type("enum"):
        bad = _present(value(f.name)) & ~value(f.name).isin(*f.values)
        if excused_enums is not None:
            bad = bad & ~F.coalesce(F.array_contains(excused_enums, f.name), F.lit(False))
        check(bad, f"enum:{f.name}")
    if check_dates:
        for f in contract.of_type("date"):
            check(_present(value(f.name)) & (~value(f.name).rlike(ISO_SHAPE) | value(f.name).try_cast("date").isNull()),
                  f"date:{f.name}")
    if check_phones:
        for f in contract.of_type("phone"):
            check(_present(value(f.name)) & ~value(f.name).rlike(E164_SHAPE), f"phone:{f.name}")
    return F.array_compact(F.array(*checks)).cast("array<string>")


def number_text(n: Column) -> Column:
    """Decimal text of a number, always with a fraction digit and never with an exponent."""
    text = n.try_cast("decimal(38,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")


def repair(contract: Contract, errors: Column) -> dict[str, Column]:
    """Field -> repaired column. Only repairs that clear the error and cannot change the meaning are made."""
    out: dict[str, Column] = {}
    for f in contract.of_type("email"):
        c = F.col(f.name)
        joined = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit(""))
        fits = F.array_contains(errors, f"email:{f.name}") & F.contains(F.trim(c), F.lit(" ")) & joined.rlike(EMAIL_SHAPE)
        out[f.name] = F.when(fits, joined).otherwise(c)
    for f in contract.of_type("decimal"):
        c = F.col(f.name)
        # The sign is kept: a negative amount stays negative, and stays invalid.
        digits = F.regexp_replace(c, r"[^\d.\-]", "")
        number = F.when(digits.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))
        wrong = F.exists(errors, lambda e: e.isin(f"number:{f.name}", f"minimum:{f.name}", f"maximum:{f.name}"))
        fits = number.isNotNull()  # an amount outside its limits is not repaired by writing it anew
        if f.min is not None:
            fits = fits & (number >= f.min)
        if f.max is not None:
            fits = fits & (number <= f.max)
        out[f.name] = F.when(wrong & fits, number_text(number)).otherwise(c)
    return out


def ladder(records: DataFrame, contract: Contract, **checks) -> DataFrame:
    """Check, repair, check again.

    Adds ``errors_before``, ``fixes`` (repaired fields), ``errors`` and
    ``outcome`` (valid or quarantined); every record comes out exactly once.
    """
    checked = records.withColumn("errors_before", error_list(contract, **checks))
    repairs = repair(contract, F.col("errors_before"))
    changed = [F.when(~F.col(n).eqNullSafe(c), F.lit(n)) for n, c in repairs.items()]
    fixes = F.array_compact(F.array(*changed)).cast("array<string>") if changed else F.array().cast("array<string>")
    fixed = checked.withColumns({"fixes": fixes, **repairs})
    again = fixed.withColumn("errors", error_list(contract, **checks))
    return again.withColumn("outcome", F.when(F.size("errors") == 0, "valid").otherwise("quarantined"))


def range_violations(df: DataFrame, limits: dict[str, tuple[float | None, float | None]],
                     keys: list[str]) -> DataFrame:
    """Rows whose numeric columns leave their limits: keys, field, value, rule."""
    found = []
    for name, (low, high) in limits.items():
        c = F.col(name).cast("double")
        for broken, rule in ((None if low is None else c < low, "minimum"), (None if high is None else c > high, "maximum")):
            if broken is not None:
                found.append(F.when(broken, F.struct(F.lit(name).alias("field"), c.alias("value"), F.lit(rule).alias("rule"))))
    return df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("v")).select(*keys, "v.*")


def orphan_references(df: DataFrame, column: str, referenced: DataFrame, key: str) -> DataFrame:
    """Rows whose non-blank ``column`` names no ``key`` of ``referenced``.

    The references are checked once per distinct value; only rows with a
    missing one are looked up again, and a missing value shared by very many
    rows is dealt out.
    """
    known = referenced.select(F.col(key).alias(column)).filter(F.col(column).isNotNull())
    missing = materialize(
        count_keys(df.filter(F.col(column).isNotNull()), [column]).join(known, column, "left_anti"), "missing")
    hot = hot_keys(missing, [column])
    spread = F.struct(*[F.col(c) for c in df.columns])
    return salted_join(df, missing.drop("n"), [column], hot, spread, "left_semi").select(*df.columns)


def date_order_violations(df: DataFrame, earlier: str, later: str, months: int = 0,
                          as_of: Column | None = None) -> DataFrame:
    """Rows where ``later`` is less than ``months`` after ``earlier``, or lies after ``as_of``."""
    first, second = F.col(earlier).cast("date"), F.col(later).cast("date")
    too_soon = second < F.add_months(first, months)
    in_future = F.lit(False) if as_of is None else second > as_of
    rule = F.when(too_soon, "too_soon").when(in_future, "in_future")
    return df.withColumn("rule", rule).filter(F.col("rule").isNotNull())
