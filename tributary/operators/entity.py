"""Linking staged rows into entities and merging each entity's fields.

Rows are taken in ``seq`` order. A row founds an entity (is a *seed*) unless
an earlier seed has its employee id, its email, or its name; any other row
belongs to the seed it meets first by id, then email, then name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.contract import Contract
from tributary.operators.skew import hot_keys, salted_join
from tributary.session import materialize

ID, EMAIL, NAME = 1, 2, 3
KIND_NAMES = {ID: "id", EMAIL: "email", NAME: "name"}


def _filled(name: str) -> Column:
    c = F.trim(name)
    return F.when(c != "", c)


def identity_columns(staged: DataFrame) -> DataFrame:
    first, last = F.lower(_filled("first_name")), F.lower(_filled("last_name"))
    return staged.select(
        "seq", _filled("employee_id").alias("by_id"), F.lower(_filled("email")).alias("by_email"),
        F.when(first.isNotNull() & last.isNotNull(), F.concat_ws("_", first, last)).alias("by_name"))


def match_key() -> Column:
    """Key of the entity a row would found: id, else email, else name and birth date, else the row itself."""
    first, last = F.lower(_filled("first_name")), F.lower(_filled("last_name"))
    name = F.concat(F.lit("name:"), first, F.lit("_"), last, F.lit("_"), F.coalesce(_filled("date_of_birth"), F.lit("")))
    return F.coalesce(
        F.concat(F.lit("id:"), _filled("employee_id")),
        F.concat(F.lit("email:"), F.lower(_filled("email"))),
        name,
        F.concat(F.lit("raw:"), F.col("source"), F.lit(":"), F.col("row_num").cast("string")))


def canonical_key(key: Column) -> Column:
    """The stored key: without its ``id:`` or ``email:`` prefix."""
    return F.regexp_replace(key, "^(id|email):", "")


def key_table(rows: DataFrame) -> DataFrame:
    """Long form (seq, has_id, kind, value) of the keys each row has."""
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")))
             for k, c in ((ID, "by_id"), (EMAIL, "by_email"), (NAME, "by_name"))]
    return rows.select("seq", F.col("by_id").isNotNull().alias("has_id"),
                       F.explode(F.array_compact(F.array(*pairs))).alias("k")).select("seq", "has_id", "k.*")


KEY = ["kind", "value"]


def _first_per_key(keys: DataFrame) -> DataFrame:
    """Row count and first rows of each key.

    Only the smallest seq per key is needed, so each key is reduced before
    the shuffle, however many rows hold it.
    """
    return keys.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_any"),
        F.min(F.when(~F.col("has_id"), F.col("seq"))).alias("first_without_id"))


def _leaders(keys: DataFrame, firsts: DataFrame, hot: DataFrame | None, guard: bool) -> DataFrame:
    """Rows that come first on every key they have."""
    rival = F.col("first_any")
    if guard:
        rival = F.when((F.col("kind") == NAME) & F.col("has_id"), F.col("first_without_id")).otherwise(rival)
    compared = salted_join(keys, firsts.drop("n"), KEY, hot, "seq").withColumn("rival", rival)
    return (compared.groupBy("seq")
            .agg(F.min(F.col("rival").isNull() | (F.col("rival") >= F.col("seq"))).alias("leads"))
            .filter("leads").select("seq"))


def _key_owners(keys: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, value) -> the first seed that has the key, and the first such seed without an id."""
    return (keys.join(seeds, "seq", "left_semi").groupBy(*KEY)
            .agg(F.min("seq").alias("owner"), F.min(F.when(~F.col("has_id"), F.col("seq"))).alias("owner_without_id")))


def _attachments(keys: DataFrame, seeds: DataFrame, hot: DataFrame | None, guard: bool) -> DataFrame:
    """For each row, the earlier seed it reaches by its strongest key.

    With the guard, a shared name does not tie two rows that both have ids.
    """
    target = F.col("owner")
    if guard:
        target = F.when((F.col("kind") == NAME) & F.col("has_id"), F.col("owner_without_id")).otherwise(target)
    reached = salted_join(keys, _key_owners(keys, seeds), KEY, hot, "seq").withColumn("target", target) \
        .filter(F.col("target") < F.col("seq"))
    return reached.groupBy("seq").agg(F.min(F.struct("kind", "target")).alias("b")).select(
        "seq", F.col("b.target").alias("entity_seq"), F.col("b.kind").alias("kind"))


def _settle(rows: DataFrame, guard: bool, max_rounds: int | None) -> DataFrame:
    """(seq, entity_seq, kind) of the rows that are not seeds, among rows with at least one key.

    A round settles every row that leads all its keys, and every row tied to
    one of those, the first open row at least, so rounds come to an end. What is left shrinks quickly; each round is written out, so
    the lineage stays short and a lost executor costs one round at most.
    """
    open_rows, open_count = rows, rows.count()
    seeds = rows.select("seq").limit(0)
    tied = rows.select("seq", F.col("seq").alias("entity_seq"), F.lit(ID).alias("kind")).limit(0)
    hot, rounds = None, 0
    while open_count:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"linking did not settle within {max_rounds} rounds")
        keys = key_table(open_rows)
        firsts = materialize(_first_per_key(keys), "firsts")
        if rounds == 1:
            hot = hot_keys(firsts, KEY, total=open_count)
        new = materialize(_leaders(keys, firsts, hot, guard), "seeds")
        tied = materialize(_attachments(keys, new, hot, guard), "tied")
        seeds = seeds.unionByName(new)
        open_count -= new.count() + tied.count()
        if open_count:
            settled = new.unionByName(tied.select("seq"))
            open_rows = materialize(open_rows.join(settled, "seq", "left_anti"), "open")
    if rounds > 1:
        # A row tied in one round may reach a seed of a later round by a stronger key.
        tied = _attachments(key_table(rows), seeds, hot, guard).join(seeds, "seq", "left_anti")
    return tied


def link(staged: DataFrame, forbid_conflicting_ids: bool = True, max_rounds: int | None = None) -> DataFrame:
    """(seq, entity_seq, matched_by): every staged row and the seed row of its entity.

    ``matched_by`` is ``seed``, ``id``, ``email`` or ``name``. ``staged`` is
    read several times, so it should be a written table (``materialize``).
    """
    rows = identity_columns(staged)
    keyed = rows.filter("by_id IS NOT NULL OR by_email IS NOT NULL OR by_name IS NOT NULL")
    attached = _settle(keyed, forbid_conflicting_ids, max_rounds)
    kind_name = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv]), F.col("kind"))
    return (rows.select("seq").join(attached, "seq", "left")
            .select("seq", F.coalesce("entity_seq", "seq").alias("entity_seq"),
                    F.coalesce(kind_name, F.lit("seed")).alias("matched_by")))


def identity_conflicts(staged: DataFrame, links: DataFrame) -> DataFrame:
    """Entities whose rows carry more than one employee id."""
    rows = staged.select("seq", _filled("employee_id").alias("employee_id")).join(links, "seq")
    return (rows.groupBy("entity_seq").agg(F.min("employee_id").alias("first_id"), F.max("employee_id").alias("last_id"))
            .filter(F.col("first_id") != F.col("last_id")))


def _rank(precedence: list[str]) -> Column:
    ranked = F.lit(99)
    for i, name in reversed(list(enumerate(precedence))):
        ranked = F.when(F.col("source") == name, i).otherwise(ranked)
    return ranked


def merge(staged: DataFrame, links: DataFrame, contract: Contract, precedence: list[str]) -> DataFrame:
    """One wide row per entity with its values, their sources, and row count.

    A sensitive field keeps its earliest value; any other field takes the
    value of the best-ranked source, earliest row first. Blank cells never
    win, so gaps are filled from the other sources. Each field is one ``min``
    over (rank, seq, value, source), combined before the shuffle.
    """
    rows = staged.withColumns({"_rank": _rank(precedence), "_key": match_key()}).join(links, "seq")
    picks = []
    for f in contract.fields:
        rank = F.lit(0) if f.sensitive else F.col("_rank")
        cell = F.struct(rank.alias("rank"), F.col("seq"), _filled(f.name).alias("value"), F.col("source"))
        picks.append(F.min(F.when(_filled(f.name).isNotNull(), cell)).alias(f"_{f.name}"))
    merged = rows.groupBy("entity_seq").agg(
        F.min(F.struct("seq", "_key")).alias("_seed"), F.count(F.lit(1)).alias("row_count"), *picks)
    names = F.array(*[F.lit(n) for n in contract.names])
    origins = F.array(*[F.col(f"_{n}.source") for n in contract.names])
    known = F.filter(F.arrays_zip(names.alias("field"), origins.alias("source")), lambda e: e["source"].isNotNull())
    return merged.select(
        "entity_seq", F.col("_seed._key").alias("match_key"), canonical_key(F.col("_seed._key")).alias("canonical_key"),
        *[F.col(f"_{n}.value").alias(n) for n in contract.names],
        F.map_from_entries(known).alias("provenance"), "row_count")


def hot_entities(merged: DataFrame) -> DataFrame | None:
    """Entities with very many rows, for joins of rows with their entity."""
    return hot_keys(merged, ["entity_seq"], "row_count")


def _cells_against_winner(staged: DataFrame, links: DataFrame, merged: DataFrame, fields: list[str]) -> DataFrame:
    """Each staged cell next to the value its entity kept, where the two differ."""
    kept = merged.select("entity_seq", "canonical_key", "provenance",
                         *[F.col(n).alias(f"_w_{n}") for n in fields])
    rows = staged.select("seq", "source", "row_num", *fields).join(links.select("seq", "entity_seq"), "seq")
    differing = [
        F.when(_filled(n) != F.col(f"_w_{n}"),
               F.struct(F.lit(n).alias("field"), _filled(n).alias("value"), F.col(f"_w_{n}").alias("winner"),
                        F.element_at("provenance", F.lit(n)).alias("winner_source")))
        for n in fields]
    return (salted_join(rows, kept, ["entity_seq"], hot_entities(merged), "seq")
            .select("entity_seq", "canonical_key", "seq", "source", "row_num",
                    F.explode(F.array_compact(F.array(*differing))).alias("c"))
            .select("entity_seq", "canonical_key", "seq", "source", "row_num", "c.*"))


def conflicts(staged: DataFrame, links: DataFrame, merged: DataFrame, contract: Contract) -> DataFrame:
    """Ledger of values that lost to a better-ranked source (non-sensitive fields)."""
    return _cells_against_winner(staged, links, merged, [f.name for f in contract.fields if not f.sensitive]).select(
        "canonical_key", "field", F.col("winner_source").alias("winning_source"),
        F.col("winner").alias("winning_value"), F.col("source").alias("losing_source"),
        F.col("value").alias("losing_value"), "row_num")


def sensitive_conflicts(staged: DataFrame, links: DataFrame, merged: DataFrame, contract: Contract) -> DataFrame:
    """One row per (entity, sensitive field) with differing values: the kept value and the first other one."""
    cells = _cells_against_winner(staged, links, merged, [f.name for f in contract.sensitive])
    return (cells.groupBy("entity_seq", "canonical_key", "field", F.col("winner_source").alias("kept_source"),
                          F.col("winner").alias("kept_value"))
            .agg(F.min(F.struct("seq", "source", "value")).alias("o"), F.count(F.lit(1)).alias("differing_rows"))
            .select("canonical_key", "field", "kept_source", "kept_value", F.col("o.source").alias("other_source"),
                    F.col("o.value").alias("other_value"), "differing_rows"))


def merge_events(staged: DataFrame, links: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows folded into an existing entity: (canonical_key, source, row_num, matched_by)."""
    folded = links.filter(F.col("matched_by") != "seed")
    rows = staged.select("seq", "source", "row_num").join(folded, "seq")
    keys = merged.select("entity_seq", "canonical_key")
    return salted_join(rows, keys, ["entity_seq"], hot_entities(merged), "seq") \
        .select("canonical_key", "source", "row_num", "matched_by")


def provenance(merged: DataFrame) -> DataFrame:
    """Long form of the provenance map: (canonical_key, field, source)."""
    return merged.select("canonical_key", F.explode("provenance").alias("field", "source"))
