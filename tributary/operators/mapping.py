"""Which target field does each source column feed? Evidence scores and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tributary.contract import Contract
from tributary.functions.similarity import indel_ratio
from tributary.operators.rules import current
from tributary.operators.skew import count_keys, hot_keys, salted_join

# Header words that name each employee field.
ALIASES = {
    "employee_id": ["emp no", "empno", "empid", "emp_id", "staff_id", "badge", "id", "employee code", "code"],
    "first_name": ["fname", "first", "given name", "first name", "firstname"],
    "last_name": ["lname", "last", "surname", "family name", "last name", "lastname"],
    "email": ["e-mail", "mail", "email address", "work email", "official email"],
    "phone": ["mobile", "cell", "contact", "phone number", "telephone"],
    "date_of_birth": ["dob", "birth date", "birthdate", "bday", "birth_date"],
    "hire_date": ["join date", "doj", "joining date", "date of joining", "start date", "hire date",
                  "commencement date"],
    "department": ["dept", "department name", "division", "business unit", "bu"],
    "job_title": ["designation", "title", "role", "position"],
    "manager_id": ["mgr", "manager", "reports to", "supervisor", "reporting manager", "mgr_id"],
    "employment_status": ["status", "emp status", "employment state"],
    "salary": ["gross salary", "annual salary", "ctc", "compensation", "base pay", "remuneration"],
}

# Headers of a composite name, and the pseudo-field it maps to.
FULL_NAME_HEADERS = ("full name", "fullname", "name")
FULL_NAME = "full_name"

# Weights of name, type and pattern evidence.
WEIGHTS = (0.55, 0.30, 0.15)


@dataclass(frozen=True)
class MappingOptions:
    auto_accept_score: float = 0.75
    min_margin: float = 0.20
    exact_name: float = 0.95
    review_floor: float = 0.50
    review_ceiling: float = 0.90
    force_review: tuple[str, ...] = ("ref",)
    aliases: dict | None = None


def normalize_header(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\-_]+", " "))


def _targets(contract: Contract, aliases: dict) -> Column:
    """The contract as a literal array; exploding it pairs a column with each field."""
    return F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("target_field"), F.lit(f.type).alias("type"),
            F.lit(f.sensitive).alias("sensitive"),
            F.array(*[F.lit(x) for x in [f.name.replace("_", " "), *aliases.get(f.name, [])]]).alias("names"))
        for i, f in enumerate(contract.fields)])


def type_evidence(field_type: Column, inferred: Column, n: Column, with_at: Column, word_hits: Column) -> Column:
    """How well a column's ``n`` distinct values fit a field type."""
    # The score of each (field type, inferred type) pair.
    return (
        F.when(field_type == "email", F.when(inferred == "email", 1.0).when(with_at > 0, 0.9).otherwise(0.1))
        .when(field_type == "decimal", F.when(inferred == "decimal", 1.0).otherwise(0.2))
        .when(field_type == "date", F.when(inferred == "date", 1.0).otherwise(0.3))
        .when(field_type == "string", 0.8)
        .when((field_type == "enum") & (n > 0), F.round(word_hits / n, 2))
        .otherwise(0.5))


def score_headers(profiles: DataFrame, contract: Contract, options: MappingOptions = MappingOptions()) -> DataFrame:
    """(source, column, target_field) with its evidence and score.

    Works on profiles made with the same contract, one row per source column,
    never on the data rows.
    """
    aliases = ALIASES if options.aliases is None else options.aliases
    paired = (profiles.select("source", "column", "distinct_count", "with_at", "hits", "inferred_type")
              .withColumn("header", normalize_header(F.col("column")))
              .withColumn("t", F.explode(_targets(contract, aliases)))
              .select("source", "column", "header", "distinct_count", "with_at", "hits", "inferred_type", "t.*"))
    n = F.col("distinct_count")

    def hits(kind: str) -> Column:
        return F.element_at("hits", F.concat(F.lit(kind + ":"), F.col("target_field")))
    best = F.array_max(F.transform("names", lambda n: indel_ratio(F.col("header"), n))) / 100.0
    scored = paired.withColumns({
        "best_name": best,
        "type_compatibility": type_evidence(F.col("type"), F.col("inferred_type"), n, F.col("with_at"), hits("words")),
        "pattern_score": F.when(hits("pattern").isNotNull() & (n > 0), hits("pattern") / n).otherwise(0.5),
    })
    by_name, by_type, by_pattern = WEIGHTS
    return scored.select(
        "source", "column", "header", "target_field", "ordinal", "sensitive",
        F.round("best_name", 3).alias("name_similarity"), "type_compatibility", "pattern_score",
        F.round(F.col("best_name") * by_name + F.col("type_compatibility") * by_type
                + F.col("pattern_score") * by_pattern, 3).alias("score"))


def rank_candidates(scores: DataFrame) -> DataFrame:
    """Best and second-best field per column; ties go to the earlier contract field."""
    order = Window.partitionBy("source", "column").orderBy(F.desc("score"), "ordinal")
    ranked = (scores.withColumn("rank", F.row_number().over(order))
              .withColumn("runner_up", F.lead("target_field").over(order))
              .withColumn("runner_up_score", F.lead("score").over(order)))
    return (ranked.filter(F.col("rank") == 1).drop("rank")
            .withColumn("margin", F.round(F.col("score") - F.coalesce("runner_up_score", F.lit(0.0)), 3)))


def decide(profiles: DataFrame, contract: Contract, rules: DataFrame | None = None,
           options: MappingOptions = MappingOptions()) -> DataFrame:
    """One row per source column: decision, target field and the evidence behind it.

    Decisions: RULE (learned mapping), FULL_NAME (composite name), ACCEPT,
    AMBIGUOUS (needs review), DROP, and DUPLICATE_TARGET for a column that
    loses its target to a better-scored column of the same source.
    """
    top = rank_candidates(score_headers(profiles, contract, options))
    ruled = _learned(top, rules)
    split_name_source = Window.partitionBy("source")
    has_names = F.max(F.col("column").isin("first_name", "last_name").cast("int")).over(split_name_source) == 1
    exact = F.col("name_similarity") >= options.exact_name
    unclear = (~exact & (F.col("score") >= options.review_floor) & (F.col("score") < options.review_ceiling)
               & (F.col("margin") < options.min_margin))
    confident = ((F.col("score") >= options.auto_accept_score) & (F.col("margin") >= options.min_margin)) | exact
    decision = (
        F.when(F.col("rule_target").isNotNull(), "RULE")
        .when(F.col("header").isin(*FULL_NAME_HEADERS) & ~has_names, "FULL_NAME")
        .when(F.col("header").isin(*options.force_review) | unclear, "AMBIGUOUS")
        .when(confident, "ACCEPT").otherwise("DROP"))
    decided = ruled.withColumn("decision", decision).withColumn(
        "mapped_to",
        F.when(F.col("decision") == "RULE", F.col("rule_target"))
        .when(F.col("decision") == "FULL_NAME", F.lit(FULL_NAME))
        .when(F.col("decision") == "ACCEPT", F.col("target_field")))
    claim = Window.partitionBy("source", "mapped_to").orderBy(
        F.when(F.col("decision") == "RULE", 0).otherwise(1), F.desc("score"), "column")
    lost = F.col("mapped_to").isNotNull() & (F.row_number().over(claim) > 1)
    decided = decided.withColumn("_lost", lost)
    return decided.select(
        "source", "column", "target_field", "score", "name_similarity", "type_compatibility", "pattern_score",
        "runner_up", "runner_up_score", "margin",
        F.when(F.col("_lost"), "DUPLICATE_TARGET").otherwise(F.col("decision")).alias("decision"),
        F.when(~F.col("_lost"), F.col("mapped_to")).alias("mapped_to"),
        F.when(F.col("decision") == "RULE", "rule").otherwise("agent").alias("decided_by"))


def _learned(top: DataFrame, rules: DataFrame | None) -> DataFrame:
    if rules is None:
        return top.withColumn("rule_target", F.lit(None).cast("string"))
    learned = current(rules, "mapping").select(
        F.col("fingerprint").alias("_fp"), F.get_json_object("action", "$.target_field").alias("rule_target"))
    return top.join(learned, F.concat_ws(":", "source", "column") == F.col("_fp"), "left").drop("_fp")


def sensitive_columns(decisions: DataFrame, contract: Contract, rules: DataFrame | None = None) -> DataFrame:
    """Accepted columns that feed sensitive fields and are not confirmed yet."""
    names = [f.name for f in contract.sensitive]
    out = decisions.filter((F.col("decision") == "ACCEPT") & F.col("mapped_to").isin(*names)) \
                   .select("source", "column", "mapped_to")
    if rules is None:
        return out
    confirmed = rules.filter(F.col("enabled") & (F.col("kind") == "sensitive_mapping_confirmed")).select(
        F.lit(1).alias("_k"))
    return out.withColumn("_k", F.lit(1)).join(confirmed, "_k", "left_anti").drop("_k")


def accepted(decisions: DataFrame) -> dict[str, dict[str, str]]:
    """{source: {column: target}}; one row per source column, so it fits the driver."""
    plan: dict[str, dict[str, str]] = {}
    for r in decisions.select("source", "column", "mapped_to").orderBy("source", "column").collect():
        plan.setdefault(r["source"], {})
        if r["mapped_to"]:
            plan[r["source"]][r["column"]] = r["mapped_to"]
    return plan


def prompt_key(system: Column, prompt: Column) -> Column:
    """Lookup key of a proposal: 16 hex digits of the SHA-256 of the trimmed texts."""
    return F.left(F.sha2(F.trim(F.concat_ws("\n", system, prompt), F.lit(" \t\n\r")), 256), F.lit(16))


def lookup_proposals(requests: DataFrame, proposals: DataFrame, fallback: Column) -> DataFrame:
    """Add ``proposal`` to requests(prompt_key, ...): the cached response, else the fallback."""
    cached = proposals.select("prompt_key", F.col("response").alias("_response"))
    hot = hot_keys(count_keys(requests, ["prompt_key"]), ["prompt_key"])
    spread = F.struct(*[F.col(c) for c in requests.columns])
    return (salted_join(requests, cached, ["prompt_key"], hot, spread, "left")
            .withColumn("cached", F.col("_response").isNotNull())
            .withColumn("proposal", F.coalesce("_response", fallback)).drop("_response"))


def enum_fallback(field: Column, raw: Column, contract: Contract) -> Column:
    """(canonical_value, confidence) proposed for an unknown enum value without a cached proposal."""
    # The known abbreviation and the two confidences.
    first_choice = F.lit(None).cast("string")
    out = F.lit(None).cast("struct<canonical_value:string,confidence:double>")
    for f in reversed(contract.of_type("enum")):
        choices = list(f.values)
        first_choice = F.lit(choices[0]) if choices else raw
        guess = F.struct(first_choice.alias("canonical_value"), F.lit(0.50).alias("confidence"))
        if "On Leave" in choices:
            known = F.struct(F.lit("On Leave").alias("canonical_value"), F.lit(0.95).alias("confidence"))
            guess = F.when(F.upper(raw) == "LOA", known).otherwise(guess)
        out = F.when(field == f.name, guess).otherwise(out)
    return out


def empty_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RULE_SCHEMA)


RULE_SCHEMA = (
    "rule_id string, client_id string, kind string, fingerprint string, action string, "
    "source_item string, enabled boolean, created_at timestamp, times_applied long"
)
