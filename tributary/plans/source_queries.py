"""Queries over sources, profiles, mapping and cell normalization."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.functions import dates, text
from tributary.operators import fuzzy, mapping, profile, sketches, staging
from tributary.plans import oracle as o
from tributary.plans.registry import query
from tributary.session import scratch_path
from tributary.sources import bridge as b, readers

_TABLES = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id"}
_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}

o.block("table_cells", " UNION ALL ".join(
    f"SELECT '{t}' AS source, col, {o.clean('v')} AS val, row_num FROM (SELECT {_TABLES[t]} + 1 AS row_num, "
    + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    + f" FROM {t}) UNPIVOT INCLUDE NULLS (v FOR col IN ({', '.join(cols)}))" for t, cols in _COLUMNS.items()))
o.profile_blocks("table_cells", "table_")
o.mapping_blocks("table_")


def tables_as_sources(spark, sf) -> list[DataFrame]:
    return [readers.from_frame(b.table(spark, sf, t), t, F.col(key) + 1) for t, key in _TABLES.items()]


@query("land_source_rows", """
SELECT 'customer' AS source, row_number() OVER (ORDER BY c_custkey) AS row_num,
       CAST(to_json({'c_custkey': CAST(c_custkey AS VARCHAR), 'c_name': c_name, 'c_nationkey': CAST(c_nationkey AS VARCHAR),
                     'c_acctbal': CAST(c_acctbal AS VARCHAR), 'c_mktsegment': c_mktsegment}) AS VARCHAR) AS raw_json
FROM customer""")
def land_source_rows(spark, sf):
    return readers.landing(readers.read_raw(spark, f"{sf}/customer.parquet", "customer"))


@query("csv_line_breaks", """
SELECT row_number() OVER (ORDER BY doc_id) AS row_num, CAST(doc_id AS VARCHAR) AS doc_id, source, text FROM documents""")
def csv_line_breaks(spark, sf):
    """Texts with line breaks, commas and quotes, written as CSV and read back by blocks of 256 KB, also on small tables."""
    path = scratch_path(spark, "texts")
    quoted = {"header": "true", "escape": '"'}
    b.table(spark, sf, "documents").select("doc_id", "source", "text").orderBy("doc_id").write.options(
        **quoted, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        rows = readers.read_raw(spark, path, "texts", "csv", multiLine="true", **quoted)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    return rows.select(F.col(readers.ROW_NUM).alias("row_num"), "doc_id", "source", "text")


@query("ingest_summary", o.with_blocks(" UNION ALL ".join(
    f"SELECT '{s}' AS source, count(*) AS row_count, {len(c)} AS column_count, '{','.join(c)}' AS columns FROM {s}"
    for s, c in o.EXPORT_COLUMNS.items()), "src_a", "src_b", "src_c"))
def ingest_summary(spark, sf):
    return readers.ingest_summary(list(b.exports(spark, sf).values()))


@query("column_profile", o.with_blocks("""
SELECT source, col AS "column", total_count, non_null_count, distinct_count,
       round(1.0 - non_null_count / total_count::DOUBLE, 3) AS null_rate,
       CASE WHEN non_null_count > 0 THEN round(distinct_count / non_null_count::DOUBLE, 3) ELSE 0.0 END AS uniqueness_ratio
FROM table_stats""", "table_stats"))
def column_profile(spark, sf):
    stats = profile.column_stats(profile.value_counts(profile.all_cells(tables_as_sources(spark, sf))))
    return stats.select("source", "column", "total_count", "non_null_count", "distinct_count", "null_rate", "uniqueness_ratio")


@query("column_samples", o.with_blocks(
    'SELECT source, col AS "column", CAST(position AS INTEGER) AS position, val AS value FROM table_samples', "table_samples"))
def column_samples(spark, sf):
    return profile.column_samples(profile.value_counts(profile.all_cells(tables_as_sources(spark, sf))))


@query("column_types", o.with_blocks(
    """SELECT source, col AS "column", inferred_type, array_to_string(samples, '|') AS samples FROM table_profiles
       UNION ALL SELECT source, col, inferred_type, array_to_string(samples, '|') FROM profiles""", "table_profiles", "profiles"))
def column_types(spark, sf):
    return profile.profile(tables_as_sources(spark, sf) + list(b.exports(spark, sf).values())).select(
        "source", "column", "inferred_type", F.array_join("sample_values", "|").alias("samples"))


def export_profiles(spark, sf) -> DataFrame:
    return profile.profile(list(b.exports(spark, sf).values()), b.CONTRACT)


@query("header_scores", o.with_blocks(
    """SELECT source, col AS "column", target_field, round(best, 3) AS name_similarity, type_compatibility, pattern_score, score
       FROM scores""", "scores"))
def header_scores(spark, sf):
    return mapping.score_headers(export_profiles(spark, sf), b.CONTRACT).select(
        "source", "column", "target_field", "name_similarity", "type_compatibility", "pattern_score", "score")


@query("mapping_decisions", o.with_blocks(
    """SELECT source, col AS "column", target_field, score, runner_up, runner_up_score, margin, decision, mapped_to
       FROM decisions""", "decisions"))
def mapping_decisions(spark, sf):
    return mapping.decide(export_profiles(spark, sf), b.CONTRACT).select(
        "source", "column", "target_field", "score", "runner_up", "runner_up_score", "margin", "decision", "mapped_to")


@query("sensitive_columns", o.with_blocks(
    """SELECT source, col AS "column", mapped_to FROM decisions
       WHERE decision = 'ACCEPT' AND mapped_to IN ('date_of_birth', 'salary')""", "decisions"))
def sensitive_columns(spark, sf):
    return mapping.sensitive_columns(mapping.decide(export_profiles(spark, sf), b.CONTRACT), b.CONTRACT)


def _raw_shape(source: str) -> str:
    """Check SQL of one source in contract shape with raw cells."""
    columns = {t: c for c, t in b.MAPPINGS[source].items()}
    cells = []
    for f in b.CONTRACT.names:
        if f in columns:
            cells.append(f"{o.clean(columns[f])} AS {f}")
        elif f in ("first_name", "last_name") and "full_name" in columns:
            split = o.first_name if f == "first_name" else o.last_name
            cells.append(f"{split(o.clean(columns['full_name']))} AS {f}")
        else:
            cells.append(f"CAST(NULL AS VARCHAR) AS {f}")
    return f"SELECT '{source}' AS source, row_num, {', '.join(cells)} FROM {source}"


@query("apply_mapping", o.with_blocks(" UNION ALL ".join(_raw_shape(s) for s in b.EXPORTS), *b.EXPORTS))
def apply_mapping(spark, sf):
    out = None
    for i, (name, df) in enumerate(b.exports(spark, sf).items()):
        part = staging.apply_mapping(df, i, b.MAPPINGS[name], b.CONTRACT).drop("source_ord", "seq")
        out = part if out is None else out.unionByName(part)
    return out


@query("staged_rows", o.with_blocks("SELECT * EXCLUDE (source_ord) FROM staged", "staged"))
def staged_rows(spark, sf):
    return b.staged(spark, sf).drop("source_ord")


_SYSTEM = "Answer as the assistant of this conversation."


@query("proposal_lookup", f"""
WITH keyed AS (SELECT conv_id, turn, role, text,
       substr(sha256(trim('{_SYSTEM}' || chr(10) || text, ' ' || chr(9) || chr(10) || chr(13))), 1, 16) AS prompt_key FROM conversations),
answers AS (SELECT u.prompt_key, arg_min(a.text, (a.conv_id, a.turn)) AS response
            FROM keyed u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
            WHERE u.role = 'user' AND a.role = 'assistant' GROUP BY 1)
SELECT k.conv_id, k.turn, k.prompt_key, r.response IS NOT NULL AS cached, coalesce(r.response, 'review required') AS proposal
FROM keyed k LEFT JOIN answers r USING (prompt_key) WHERE k.role = 'user'""")
def proposal_lookup(spark, sf):
    turns = b.table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").withColumn("prompt_key", mapping.prompt_key(F.lit(_SYSTEM), F.col("text")))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    first = F.min(F.struct("conv_id", "turn", "reply"))["reply"]
    cache = asked.join(replies, ["conv_id", "turn"]).groupBy("prompt_key").agg(first.alias("response"))
    return mapping.lookup_proposals(asked.select("conv_id", "turn", "prompt_key"), cache, F.lit("review required")) \
                  .select("conv_id", "turn", "prompt_key", "cached", "proposal")


@query("clean_text", o.with_blocks(f"""
SELECT row_num, {o.name_case(o.clean('first_name'))} AS first_name, {o.name_case(o.clean('last_name'))} AS last_name FROM src_a""", "src_a"))
def clean_text(spark, sf):
    return b.export(spark, sf, "src_a").select(
        F.col(readers.ROW_NUM).alias("row_num"), text.name_case(F.col("first_name")).alias("first_name"),
        text.name_case(F.col("last_name")).alias("last_name"))


@query("clean_email", o.with_blocks(f"SELECT row_num, {o.email(o.clean('email'))} AS email FROM src_a", "src_a"))
def clean_email(spark, sf):
    return b.export(spark, sf, "src_a").select(F.col(readers.ROW_NUM).alias("row_num"), text.email(F.col("email")).alias("email"))


@query("phone_e164", o.with_blocks(f"SELECT row_num, phone AS raw, {o.phone(o.clean('phone'))} AS phone FROM src_c", "src_c"))
def phone_e164(spark, sf):
    return b.export(spark, sf, "src_c").select(
        F.col(readers.ROW_NUM).alias("row_num"), F.col("phone").alias("raw"), text.phone_e164(F.col("phone")).alias("phone"))


@query("split_name", o.with_blocks(" UNION ALL ".join(
    f"SELECT '{s}' AS source, row_num, {o.first_name(o.clean(c))} AS first_name, {o.last_name(o.clean(c))} AS last_name FROM {s}"
    for s, c in (("src_b", "full_name"), ("src_c", "name"))), "src_b", "src_c"))
def split_name(spark, sf):
    def split(source, column):
        first, last = text.split_full_name(F.col(column))
        return b.export(spark, sf, source).select(
            F.col(readers.SOURCE).alias("source"), F.col(readers.ROW_NUM).alias("row_num"),
            first.alias("first_name"), last.alias("last_name"))
    return split("src_b", "full_name").unionByName(split("src_c", "name"))


_DATES = {"src_a": ["dob", "join_date"], "src_b": ["doj"], "src_c": ["birth_date"]}

o.block("date_orders", " UNION ALL ".join(f"""
SELECT '{s}' AS source, '{c}' AS "column",
       CASE WHEN count_if(d IS NOT NULL AND m IS NULL) > 0 AND count_if(m IS NOT NULL AND d IS NULL) > 0 THEN 'AMBIGUOUS'
            WHEN count_if(d IS NOT NULL AND m IS NULL) > 0 THEN 'DMY' WHEN count_if(m IS NOT NULL AND d IS NULL) > 0 THEN 'MDY'
            WHEN count_if(d IS NOT NULL AND m IS NOT NULL) > 0 THEN 'AMBIGUOUS'
            WHEN count_if(iso IS NOT NULL) > 0 THEN 'YMD' END AS date_order
FROM (SELECT try_strptime({o.clean(c)}, '%d/%m/%Y') AS d, try_strptime({o.clean(c)}, '%m/%d/%Y') AS m,
             try_strptime({o.clean(c)}, '%Y-%m-%d') AS iso FROM {s})""" for s, cols in _DATES.items() for c in cols), *_DATES)


def export_date_orders(spark, sf) -> DataFrame:
    out = None
    for source, columns in _DATES.items():
        part = staging.column_date_orders(b.export(spark, sf, source), source, columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("date_format_by_column", o.with_blocks("SELECT * FROM date_orders", "date_orders"))
def date_format_by_column(spark, sf):
    return export_date_orders(spark, sf).drop("decided_by")


@query("dates_to_iso", o.with_blocks(" UNION ALL ".join(f"""
SELECT '{s}' AS source, '{c}' AS "column", row_num, {o.clean(c)} AS raw,
       CASE '{kind}' WHEN 'withheld' THEN NULL WHEN 'DMY' THEN {o.dmy(o.clean(c))} ELSE {o.clean(c)} END AS iso FROM {s}"""
    for s, c, kind in (("src_a", "dob", "DMY"), ("src_a", "join_date", "DMY"), ("src_b", "doj", "withheld"),
                       ("src_c", "birth_date", "ISO"))), *_DATES))
def dates_to_iso(spark, sf):
    out = None
    for source, columns in _DATES.items():
        df = b.export(spark, sf, source)
        orders = staging.column_date_orders(df, source, columns)
        found = {r["column"]: r["date_order"] for r in orders.collect()}
        for c in columns:
            order = F.lit(found[c])
            part = df.select(F.col(readers.SOURCE).alias("source"), F.lit(c).alias("column"), F.col(readers.ROW_NUM).alias("row_num"),
                             F.col(c).alias("raw"), dates.to_iso(F.col(c), order).alias("iso"))
            out = part if out is None else out.unionByName(part)
    return out


@query("enum_normalize", o.with_blocks(" UNION ALL ".join(
    f"SELECT '{s}' AS source, row_num, {o.enum(o.clean('dept'), 'department')} AS department, "
    f"{o.enum(o.clean('status'), 'employment_status')} AS employment_status FROM {s}" for s in ("src_a", "src_c")), "src_a", "src_c"))
def enum_normalize(spark, sf):
    def values(source):
        return b.export(spark, sf, source).select(
            F.col(readers.SOURCE).alias("source"), F.col(readers.ROW_NUM).alias("row_num"),
            staging.enum_value(F.col("dept"), b.CONTRACT["department"], b.CONTRACT).alias("department"),
            staging.enum_value(F.col("status"), b.CONTRACT["employment_status"], b.CONTRACT).alias("employment_status"))
    return values("src_a").unionByName(values("src_c"))


@query("enum_unrecognized", o.with_blocks(
    "SELECT field, upper(value) AS raw_value, count(*) AS affected_rows FROM unrecognized GROUP BY ALL", "unrecognized"))
def enum_unrecognized(spark, sf):
    return staging.unrecognized_groups(b.staged(spark, sf), b.CONTRACT)


_ORDER_ENUM = {"Open": ["o"], "Filled": ["f"], "Partial": ["p"]}


@query("order_status_enum", """
SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'o' THEN 'Open' WHEN 'f' THEN 'Filled' WHEN 'p' THEN 'Partial' ELSE o_orderstatus END AS status,
       o_orderpriority AS priority FROM orders""")
def order_status_enum(spark, sf):
    from tributary.contract import Field
    status = Field("status", "enum", values=_ORDER_ENUM)
    return b.table(spark, sf, "orders").select(
        "o_orderkey", staging.enum_value(text.clean("o_orderstatus"), status, b.CONTRACT).alias("status"),
        F.col("o_orderpriority").alias("priority"))


# Product names as people type them: letters lost, doubled, replaced or swapped for capitals.
_TYPED = """SELECT p_partkey, CAST('product' AS STRING) AS field, CASE p_partkey % 8
  WHEN 0 THEN word WHEN 1 THEN substr(word, 1, i) || substr(word, i + 2) WHEN 2 THEN substr(word, 1, i) || substr(word, i)
  WHEN 3 THEN substr(word, 1, i) || 'x' || substr(word, i + 2) WHEN 4 THEN upper(substr(word, 1, i)) || substr(word, i + 2)
  WHEN 5 THEN substr(word, 3) WHEN 6 THEN word || 'sy' ELSE 'no. ' || CAST(p_partkey AS STRING) END AS value
FROM (SELECT p_partkey, word, CAST(1 + p_partkey % length(word) AS INT) AS i
      FROM (SELECT p_partkey, lower(p_type) || ' ' || p_name AS word FROM part))"""
_PRODUCTS = "SELECT DISTINCT CAST('product' AS STRING) AS field, lower(p_type) || ' ' || p_name AS word, upper(lower(p_type) || ' ' || p_name) AS canonical FROM part"


_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz .0123456789', ''), lambda c: length({0}) - length(replace({0}, c, '')))"


@query("enum_fuzzy", f"""
WITH typed AS MATERIALIZED ({_TYPED.replace('STRING', 'VARCHAR')}), words AS MATERIALIZED (SELECT *, {_LETTERS.format('word')} AS wl FROM ({_PRODUCTS.replace('STRING', 'VARCHAR')})),
unknown AS MATERIALIZED (SELECT *, {_LETTERS.format('value')} AS vl FROM (SELECT DISTINCT field, lower(trim(value)) AS value FROM typed WHERE lower(trim(value)) NOT IN (SELECT word FROM words))),
near AS MATERIALIZED (SELECT field, value, word, canonical, similarity FROM (
  SELECT u.field, value, word, canonical, {o.ratio('value', 'word')} AS similarity FROM unknown u JOIN words w ON u.field = w.field
  -- two texts have no more letters in common, in order, than they have in common at all
  WHERE 2.0 * list_sum(list_transform(list_zip(wl, vl), lambda p: least(p[1], p[2]))) / (length(value) + length(word)) >= 0.9) WHERE similarity >= 90),
best AS (SELECT field, value, arg_min(canonical, word) AS canonical, min(word) AS word, any_value(similarity) AS similarity
         FROM (SELECT *, max(similarity) OVER (PARTITION BY field, value) AS most FROM near) WHERE similarity = most
         GROUP BY field, value HAVING count(DISTINCT canonical) = 1)
SELECT field, value, canonical, word, round(similarity, 4) AS similarity FROM best""")
def enum_fuzzy(spark, sf):
    typed, words = (b.view(spark, sf, sql, "part") for sql in (_TYPED, _PRODUCTS))
    return fuzzy.closest_words(typed.select("field", "value"), words).withColumn("similarity", F.round("similarity", 4))


@query("profile_sketches", o.with_blocks("""
SELECT source, col AS "column", total_count, non_null_count, inferred_type, true AS distinct_is_near,
       CASE WHEN non_null_count > 0 THEN round(1.0 - non_null_count / total_count::DOUBLE, 3) ELSE 1.0 END AS null_rate
FROM table_profiles WHERE source IN ('customer', 'orders')""", "table_profiles"))
def profile_sketches(spark, sf):
    """Profiles merged from sketches of the table files; the estimate of the distinct values is held against their number."""
    store = scratch_path(spark, "sketches")
    tables = ("customer", "orders")
    for name in tables:
        sketches.load(spark, f"{sf.rstrip('/')}/{name}.parquet", name, "parquet", store)
        sketches.load(spark, f"{sf.rstrip('/')}/{name}.parquet", name, "parquet", store)  # nothing new
    made = sketches.profiles(spark, store)
    cells = profile.all_cells([d for t, d in zip(_TABLES, tables_as_sources(spark, sf)) if t in tables])
    counted = profile.column_stats(profile.value_counts(cells)).select("source", "column", F.col("distinct_count").alias("counted"))
    near = F.abs(F.col("distinct_count") - F.col("counted")) <= 0.05 * F.col("counted")
    return made.join(counted, ["source", "column"]).select("source", "column", "total_count", "non_null_count", "inferred_type", near.alias("distinct_is_near"), "null_rate")
