"""Mapped and normalized source rows in contract shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tributary.contract import Contract, Field
from tributary.functions import dates, text
from tributary.operators import fuzzy
from tributary.operators.mapping import FULL_NAME
from tributary.operators.rules import current
from tributary.operators.skew import lookup
from tributary.session import materialize
from tributary.sources.readers import ROW_NUM, SOURCE

LINEAGE = ["source", "source_ord", "row_num", "seq"]
_ROW_BITS = 44


def sequence_number(source_ord: int, row_num: Column) -> Column:
    """One long that orders rows by source, then by row."""
    return F.lit(source_ord << _ROW_BITS).cast("long") + row_num


def apply_mapping(df: DataFrame, source_ord: int, mapping: dict[str, str], contract: Contract) -> DataFrame:
    """Rename and prune one source to contract fields, values still raw; absent fields are NULL."""
    by_target = {target: column for column, target in mapping.items()}
    out: dict[str, Column] = {}
    if FULL_NAME in by_target:
        whole = F.col(f"`{by_target[FULL_NAME]}`")
        out["first_name"], out["last_name"] = text.split_full_name(whole)
    for f in contract.fields:
        if f.name in by_target:
            out[f.name] = F.col(f"`{by_target[f.name]}`")
        else:
            out.setdefault(f.name, F.lit(None).cast("string"))
    return df.select(
        F.col(SOURCE).alias("source"), F.lit(source_ord).alias("source_ord"), F.col(ROW_NUM).alias("row_num"),
        sequence_number(source_ord, F.col(ROW_NUM)).alias("seq"),
        *[_blank_to_null(out[n]).alias(n) for n in contract.names])


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def column_date_orders(df: DataFrame, source: str, date_columns: list[str],
                       rules: DataFrame | None = None) -> DataFrame:
    """(source, column, date_order, decided_by) for the date columns of one source, in one scan; each different text is read once."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in date_columns]))
    texts = df.select(cells.alias("e")).select("e.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    wide = texts.agg(*[dates.order_of_column(F.when(F.col("column") == c, F.col("value")), F.col("n")).alias(c) for c in date_columns])
    found = (wide.unpivot([], date_columns, "column", "date_order")
             .select(F.lit(source).alias("source"), "column", "date_order"))
    found = found.withColumn("decided_by", F.lit("agent"))
    return found if rules is None else with_learned_orders(found, rules)


def with_learned_orders(found: DataFrame, rules: DataFrame) -> DataFrame:
    """The date orders that the columns' cells show, replaced where a rule of the client gives one."""
    learned = current(rules, "date_format").select(
        F.col("fingerprint").alias("_fp"), F.get_json_object("action", "$.format").alias("_rule"))
    return (found.join(learned, F.concat_ws(":", "source", "column") == F.col("_fp"), "left")
            .select("source", "column", F.coalesce("_rule", "date_order").alias("date_order"),
                    F.when(F.col("_rule").isNotNull(), "rule").otherwise("agent").alias("decided_by")))


def date_orders(df: DataFrame, source: str, mapping: dict[str, str], contract: Contract,
                rules: DataFrame | None = None) -> DataFrame | None:
    columns = [c for c, t in mapping.items() if t in contract and contract[t].type == "date"]
    return column_date_orders(df, source, columns, rules) if columns else None


def enum_value(c: Column, f: Field, contract: Contract, learned: Column | None = None) -> Column:
    """Canonical value of a cell; a learned value next; the raw text when both are unknown."""
    known = F.element_at(contract.literal_map(f.vocabulary()), F.lower(c))
    return F.coalesce(known, c) if learned is None else F.coalesce(known, learned, c)


def normalize(staged: DataFrame, contract: Contract, orders: dict[str, str | None] | None = None,
              rules: DataFrame | None = None, phone_region: str = "IN", near_words: DataFrame | None = None) -> DataFrame:
    """Normalize every contract field by its type; ``orders`` gives the date order of each date field.

    An enum cell is looked up among the contract's words, then among the
    learned values of ``rules`` (one client's), then in ``near_words``
    (see ``near_enum_words``).
    """
    orders = orders or {}
    learned = learned_enums(rules, near_words)
    if learned is not None:
        staged = _with_learned_enums(staged, contract, learned)
    out = []
    for f in contract.fields:
        c = F.col(f.name)
        if f.type == "string" and "name" in f.name:
            c = text.name_case(c)
        elif f.type == "string" and "title" in f.name:
            c = text.squeeze(c)
        elif f.type == "email":
            c = text.email(c)
        elif f.type == "phone":
            c = text.phone_e164(c, phone_region)
        elif f.type == "date":
            c = dates.to_iso(c, F.lit(orders.get(f.name)).cast("string"))
        elif f.type == "enum":
            c = enum_value(c, f, contract, F.col(f"_learned_{f.name}") if learned is not None else None)
        out.append(c.alias(f.name))
    return staged.select(*LINEAGE, *out)


def learned_enums(rules: DataFrame | None, near_words: DataFrame | None = None) -> DataFrame | None:
    """(fingerprint, canonical) of learned values and, where there is no rule, of almost known ones; each fingerprint once."""
    parts = []
    if rules is not None:
        parts.append(current(rules, "enum_value").select("fingerprint", F.get_json_object("action", "$.canonical_value").alias("canonical")))
    if near_words is not None:
        near = near_words.select(F.concat_ws(":", "field", F.upper("value")).alias("fingerprint"), "canonical")
        near = near.groupBy("fingerprint").agg(F.min("canonical").alias("canonical"))
        parts.append(near.join(parts[0].select("fingerprint"), "fingerprint", "left_anti") if parts else near)
    return reduce(DataFrame.unionByName, parts) if parts else None


def _with_learned_enums(staged: DataFrame, contract: Contract, learned: DataFrame) -> DataFrame:
    for f in contract.of_type("enum"):
        mine = learned.filter(F.startswith("fingerprint", F.lit(f.name + ":"))).select(
            F.substring("fingerprint", F.lit(len(f.name) + 2), F.length("fingerprint")).alias("_raw"),
            F.col("canonical").alias(f"_learned_{f.name}"))
        # Words of the contract need no rule, so only the others are looked up.
        unknown = F.element_at(contract.literal_map(f.vocabulary()), F.lower(f.name)).isNull()
        staged = lookup(staged.withColumn("_raw", F.when(unknown, F.upper(f.name))), mine, "_raw", "seq").drop("_raw")
    return staged


def near_enum_words(raw: list[DataFrame], contract: Contract, threshold: float) -> DataFrame:
    """(field, value, canonical, word, similarity) for the distinct unknown enum values of mapped rows; a written table."""
    fields = contract.of_type("enum")
    cells = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("value")) for f in fields]))
    values = reduce(DataFrame.unionByName, [rows.select(cells.alias("c")).select("c.*").filter("value IS NOT NULL").distinct() for rows in raw])
    return materialize(fuzzy.closest_words(values, fuzzy.vocabulary(contract, values), threshold), "near_words")


def all_date_orders(sources: dict[str, DataFrame], mappings: dict[str, dict[str, str]], contract: Contract,
                    rules: DataFrame | None = None) -> DataFrame | None:
    """The date orders of all sources; NULL when no date column is mapped."""
    out = None
    for name, df in sources.items():
        part = date_orders(df, name, mappings.get(name, {}), contract, rules)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


def stage(sources: dict[str, DataFrame], mappings: dict[str, dict[str, str]], contract: Contract,
          rules: DataFrame | None = None, default_date_order: str | None = None,
          phone_region: str = "IN", orders: DataFrame | None = None, enum_threshold: float | None = None) -> DataFrame:
    """All sources, in the given order, as one table of normalized contract rows.

    With ``enum_threshold`` an enum value that is neither a word nor learned
    becomes that of the one word it is most like, at this similarity in percent
    or more. ``rules`` are one client's.

    The date orders (one row per date column) come to the driver, so that the
    row expressions hold only the branch each column needs; ``orders`` passes
    them in when they are known already.
    """
    if orders is None:
        orders = all_date_orders(sources, mappings, contract, rules)
    known = {(r["source"], r["column"]): r["date_order"] for r in orders.collect()} if orders is not None else {}
    raw = {name: apply_mapping(df, i, mappings[name], contract) for i, (name, df) in enumerate(sources.items()) if mappings.get(name)}
    near = None
    if enum_threshold is not None and raw and contract.of_type("enum"):
        near = near_enum_words(list(raw.values()), contract, enum_threshold)
    out = None
    for name, rows in raw.items():
        mapping = mappings[name]
        by_field = {}
        for column, target in mapping.items():
            order = known.get((name, column))
            by_field[target] = default_date_order if order == dates.AMBIGUOUS and default_date_order else order
        part = normalize(rows, contract, by_field, rules, phone_region, near)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source has a mapped column")
    return out


def unrecognized_enums(staged: DataFrame, contract: Contract) -> DataFrame:
    """Cells whose enum value is not canonical: (source, row_num, seq, field, value, fingerprint)."""
    found = [F.when(F.col(f.name).isNotNull() & ~F.col(f.name).isin(*f.values),
                    F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("value")))
             for f in contract.of_type("enum")]
    return (staged.select("source", "row_num", "seq", F.explode(F.array_compact(F.array(*found))).alias("e"))
            .select("source", "row_num", "seq", "e.field", "e.value",
                    F.concat_ws(":", "e.field", F.upper("e.value")).alias("fingerprint")))


def unrecognized_groups(staged: DataFrame, contract: Contract) -> DataFrame:
    """One row per (field, upper-cased value) with the number of affected rows."""
    return (unrecognized_enums(staged, contract)
            .groupBy("field", F.upper("value").alias("raw_value")).agg(F.count(F.lit(1)).alias("affected_rows")))
