"""Building blocks of the check SQL: each common table expression with the ones it needs."""

from __future__ import annotations

from tributary.functions.text import NULL_TOKENS
from tributary.operators.mapping import ALIASES
from tributary.operators.profile import DATE_LIKE
from tributary.sources.bridge import ATTEMPTS, CONTRACT, EXPORTS, LEDGER, MAPPINGS, PRECEDENCE

EXPORT_COLUMNS = {
    "src_a": ["emp_no", "first_name", "last_name", "email", "dob", "join_date", "dept", "status", "mgr", "salary"],
    "src_b": ["emp_id", "full_name", "email_address", "gross_salary", "doj"],
    "src_c": ["name", "mail", "phone", "birth_date", "ref", "status", "dept"],
}
_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, sql: str, *needs: str) -> None:
    _BLOCKS[name] = (needs, sql)


def sql_of(name: str) -> str:
    return _BLOCKS[name][1]


def with_blocks(select: str, *names: str) -> str:
    """``WITH`` all named blocks and what they depend on, then the select."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in _BLOCKS[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)
    for n in names:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_BLOCKS[n][1]})" for n in ordered) + "\n" + select


def quoted(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def string_list(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]::VARCHAR[]"


def clean(c: str) -> str:
    tokens = ", ".join(quoted(t) for t in NULL_TOKENS)
    return f"(CASE WHEN lower(trim({c})) IN ({tokens}) THEN NULL ELSE trim({c}) END)"


def title(c: str) -> str:
    """Title case of texts made of letters and single spaces."""
    return (f"array_to_string(list_transform(string_split(lower({c}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def squeeze(c: str) -> str:
    return f"regexp_replace(trim({c}), '\\s+', ' ', 'g')"


def name_case(c: str) -> str:
    s = squeeze(c)
    return f"(CASE WHEN upper({s}) = {s} OR lower({s}) = {s} THEN {title(s)} ELSE {s} END)"


def first_name(c: str) -> str:
    return title(f"string_split({squeeze(c)}, ' ')[1]")


def last_name(c: str) -> str:
    return title(f"array_to_string(string_split({squeeze(c)}, ' ')[2:], ' ')")


def email(c: str) -> str:
    return f"replace(lower(trim({c})), ' ', '')"


def phone(c: str) -> str:
    """E.164 of Indian numbers, the only kind in the exports."""
    d = f"regexp_replace({c}, '[^\\d+]', '', 'g')"
    return (f"(CASE WHEN regexp_full_match({d}, '\\+91[1-9]\\d{{9}}') THEN {d} "
            f"WHEN regexp_full_match({d}, '0?[1-9]\\d{{9}}') THEN '+91' || right({d}, 10) ELSE {d} END)")


def dmy(c: str) -> str:
    return f"strftime(try_strptime({c}, '%d/%m/%Y'), '%Y-%m-%d')"


def enum(c: str, field: str) -> str:
    arms = " ".join(f"WHEN {quoted(w)} THEN {quoted(v)}" for w, v in CONTRACT[field].vocabulary().items())
    return f"(CASE lower({c}) {arms} ELSE {c} END)"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, by the textbook table kept one row at a time."""
    row = (f"list_reduce(range(1, length({a}) + 1), lambda acc, i: list_append(acc, "
           f"CASE WHEN substr({a}, i, 1) = ch THEN prev[i] + 1 ELSE greatest(prev[i + 1], acc[i]) END), [0::BIGINT])")
    return (f"list_reduce(string_split({b}, ''), lambda prev, ch: {row}, "
            f"list_transform(range(0, length({a}) + 1), lambda z: 0::BIGINT))[-1]")


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 100.0 ELSE 200.0 * {lcs(a, b)} / (length({a}) + length({b})) END)::DOUBLE"


for _name, _sql in EXPORTS.items():
    block(_name, _sql)
block("ledger", LEDGER)
block("attempts", ATTEMPTS)

# -- profiles and mapping ------------------------------------------------------------------

block("cells", " UNION ALL ".join(
    f"SELECT '{s}' AS source, col, {clean('v')} AS val, row_num FROM {s} "
    f"UNPIVOT INCLUDE NULLS (v FOR col IN ({', '.join(cols)}))" for s, cols in EXPORT_COLUMNS.items()), *EXPORTS)


def profile_blocks(cells: str, prefix: str) -> None:
    block(f"{prefix}counts", f"SELECT source, col, val, count(*) AS n, min(row_num) AS first_row FROM {cells} GROUP BY ALL", cells)
    block(f"{prefix}stats", f"""
SELECT source, col, sum(n)::BIGINT AS total_count, coalesce(sum(n) FILTER (WHERE val IS NOT NULL), 0)::BIGINT AS non_null_count,
       count(val) AS distinct_count
FROM {prefix}counts GROUP BY source, col""", f"{prefix}counts")
    block(f"{prefix}samples", f"""
SELECT source, col, val, row_number() OVER (PARTITION BY source, col ORDER BY first_row) AS position
FROM {prefix}counts WHERE val IS NOT NULL QUALIFY position <= 5""", f"{prefix}counts")
    # The samples are for display; evidence is taken from all distinct values.
    block(f"{prefix}profiles", f"""
SELECT s.*, coalesce(l.samples, []::VARCHAR[]) AS samples, coalesce(d.vals, []::VARCHAR[]) AS vals,
       CASE WHEN d.vals IS NULL THEN 'string'
            WHEN len(list_filter(d.vals, lambda v: contains(v, '@') AND contains(v, '.'))) = len(d.vals) THEN 'email'
            WHEN len(list_filter(d.vals, lambda v: TRY_CAST(regexp_replace(v, '[,$]', '', 'g') AS DOUBLE) IS NOT NULL))
                 >= 0.8 * len(d.vals) THEN 'decimal'
            WHEN len(list_filter(d.vals, lambda v: regexp_matches(v, {quoted(DATE_LIKE)}))) >= 0.7 * len(d.vals) THEN 'date'
            ELSE 'string' END AS inferred_type
FROM {prefix}stats s LEFT JOIN
     (SELECT source, col, list(val ORDER BY position) AS samples FROM {prefix}samples GROUP BY source, col) l USING (source, col) LEFT JOIN
     (SELECT source, col, list(val) AS vals FROM {prefix}counts WHERE val IS NOT NULL GROUP BY source, col) d USING (source, col)
""", f"{prefix}stats", f"{prefix}samples", f"{prefix}counts")


profile_blocks("cells", "")

block("targets", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {quoted(f.name)}, {quoted(f.type)}, {f.sensitive}, "
    f"{string_list([f.name.replace('_', ' '), *ALIASES[f.name]])}, {string_list(f.vocabulary())}, {quoted(f.anchored_pattern)})"
    for i, f in enumerate(CONTRACT.fields)) + ") t(ordinal, target_field, type, sensitive, names, words, pattern)")


def mapping_blocks(p: str) -> None:
    """Scores and decisions for the profiles with this prefix."""
    block(f"{p}name_scores", f"""
    SELECT source, col, target_field, max({ratio('header', 'alias')}) / 100.0 AS best
    FROM (SELECT source, col, trim(regexp_replace(lower(col), '[\\s\\-_]+', ' ', 'g')) AS header, target_field, unnest(names) AS alias
          FROM {p}profiles CROSS JOIN targets) GROUP BY source, col, target_field""", f"{p}profiles", "targets")
    block(f"{p}scores", f"""
    SELECT *, round(best * 0.55 + type_compatibility * 0.30 + pattern_score * 0.15, 3) AS score FROM (
      SELECT p.source, p.col, t.target_field, t.ordinal, t.sensitive, n.best,
             CASE t.type WHEN 'email' THEN CASE WHEN inferred_type = 'email' THEN 1.0
                                                WHEN len(list_filter(vals, lambda v: contains(v, '@'))) > 0 THEN 0.9 ELSE 0.1 END
                         WHEN 'decimal' THEN CASE WHEN inferred_type = 'decimal' THEN 1.0 ELSE 0.2 END
                         WHEN 'date' THEN CASE WHEN inferred_type = 'date' THEN 1.0 ELSE 0.3 END
                         WHEN 'string' THEN 0.8
                         WHEN 'enum' THEN CASE WHEN len(vals) > 0 THEN round(len(list_filter(vals,
                              lambda v: list_contains(words, lower(trim(v))))) / len(vals)::DOUBLE, 2) ELSE 0.5 END
                         ELSE 0.5 END::DOUBLE AS type_compatibility,
             CASE WHEN pattern IS NOT NULL AND len(vals) > 0
                  THEN len(list_filter(vals, lambda v: regexp_matches(trim(v), pattern))) / len(vals)::DOUBLE
                  ELSE 0.5 END::DOUBLE AS pattern_score
      FROM {p}profiles p CROSS JOIN targets t JOIN {p}name_scores n ON n.source = p.source AND n.col = p.col AND n.target_field = t.target_field)
    """, f"{p}profiles", "targets", f"{p}name_scores")
    block(f"{p}decisions", f"""
    SELECT *, CASE WHEN decision = 'FULL_NAME' THEN 'full_name' WHEN decision = 'ACCEPT' THEN target_field END AS mapped_to FROM (
      SELECT *, CASE WHEN header IN ('full name', 'fullname', 'name') AND NOT has_names THEN 'FULL_NAME'
                     WHEN header = 'ref' OR (name_similarity < 0.95 AND score >= 0.50 AND score < 0.90 AND margin < 0.20) THEN 'AMBIGUOUS'
                     WHEN (score >= 0.75 AND margin >= 0.20) OR name_similarity >= 0.95 THEN 'ACCEPT' ELSE 'DROP' END AS decision
      FROM (SELECT *, round(best, 3) AS name_similarity, trim(regexp_replace(lower(col), '[\\s\\-_]+', ' ', 'g')) AS header,
                   round(score - runner_up_score, 3) AS margin,
                   bool_or(col IN ('first_name', 'last_name')) OVER (PARTITION BY source) AS has_names
            FROM (SELECT *, row_number() OVER w AS rank, lead(target_field) OVER w AS runner_up, lead(score) OVER w AS runner_up_score
                  FROM {p}scores WINDOW w AS (PARTITION BY source, col ORDER BY score DESC, ordinal))
            WHERE rank = 1))""", f"{p}scores")


mapping_blocks("")

# -- staged rows -----------------------------------------------------------------------------

_RENAMED = {
    "src_a": {**{t: c for c, t in MAPPINGS["src_a"].items()}},
    "src_b": {**{t: c for c, t in MAPPINGS["src_b"].items()}},
    "src_c": {**{t: c for c, t in MAPPINGS["src_c"].items()}},
}


def _staged_cell(source: str, field: str) -> str:
    columns = _RENAMED[source]
    if field in ("first_name", "last_name") and "full_name" in columns:
        split = first_name if field == "first_name" else last_name
        return f"nullif({split(clean(columns['full_name']))}, '')"
    if field not in columns:
        return "CAST(NULL AS VARCHAR)"
    c = clean(columns[field])
    kind = CONTRACT[field].type
    if field in ("first_name", "last_name"):
        return name_case(c)
    if kind == "email":
        return email(c)
    if kind == "phone":
        return phone(c)
    if kind == "date":
        return c if source == "src_c" else dmy(c)
    if kind == "enum":
        return enum(c, field)
    return c


for _i, _s in enumerate(EXPORTS):
    block(f"staged_{_s}", f"SELECT '{_s}' AS source, {_i} AS source_ord, row_num, ({_i}::BIGINT << 44) + row_num AS seq, " + ", ".join(
        f"{_staged_cell(_s, f)} AS {f}" for f in CONTRACT.names) + f" FROM {_s}", _s)
block("staged", " UNION ALL ".join(f"SELECT * FROM staged_{s}" for s in EXPORTS), *[f"staged_{s}" for s in EXPORTS])
block("unrecognized", " UNION ALL ".join(
    f"SELECT source, row_num, seq, '{f.name}' AS field, {f.name} AS value, '{f.name}:' || upper({f.name}) AS fingerprint FROM staged "
    f"WHERE {f.name} IS NOT NULL AND {f.name} NOT IN ({', '.join(quoted(v) for v in f.values)})"
    for f in CONTRACT.of_type("enum")), "staged")

# -- entities --------------------------------------------------------------------------------

block("identity", """
SELECT seq, source, row_num, employee_id AS by_id, lower(email) AS by_email,
       CASE WHEN first_name IS NOT NULL AND last_name IS NOT NULL THEN lower(first_name) || '_' || lower(last_name) END AS by_name,
       coalesce('id:' || employee_id, 'email:' || lower(email),
                'name:' || lower(first_name) || '_' || lower(last_name) || '_' || coalesce(date_of_birth, ''),
                'raw:' || source || ':' || row_num) AS match_key
FROM staged""", "staged")
# A row leads when it comes first on each of its keys; a shared name does not tie two rows that both have ids.
block("leaders", """
SELECT * FROM (
  SELECT *, min(seq) OVER (PARTITION BY by_id) AS id_first, min(seq) OVER (PARTITION BY by_email) AS email_first,
         min(seq) OVER (PARTITION BY by_name) AS name_first,
         min(seq) FILTER (WHERE by_id IS NULL) OVER (PARTITION BY by_name) AS idless_first
  FROM identity)
WHERE (by_id IS NULL OR id_first >= seq) AND (by_email IS NULL OR email_first >= seq)
  AND (by_name IS NULL OR (by_id IS NULL AND name_first >= seq) OR (by_id IS NOT NULL AND coalesce(idless_first, seq) >= seq))
""", "identity")
block("links", """
SELECT r.seq, coalesce(l.seq, i.seq, e.seq, n.seq) AS entity_seq,
       CASE WHEN l.seq IS NOT NULL THEN 'seed' WHEN i.seq IS NOT NULL THEN 'id' WHEN e.seq IS NOT NULL THEN 'email' ELSE 'name' END AS matched_by
FROM identity r
LEFT JOIN leaders l ON l.seq = r.seq
LEFT JOIN (SELECT by_id, min(seq) AS seq FROM leaders WHERE by_id IS NOT NULL GROUP BY 1) i ON i.by_id = r.by_id AND i.seq < r.seq
LEFT JOIN (SELECT by_email, min(seq) AS seq FROM leaders WHERE by_email IS NOT NULL GROUP BY 1) e ON e.by_email = r.by_email AND e.seq < r.seq
LEFT JOIN (SELECT by_name, min(seq) AS seq, min(seq) FILTER (WHERE by_id IS NULL) AS idless FROM leaders WHERE by_name IS NOT NULL GROUP BY 1) nn
       ON nn.by_name = r.by_name
LEFT JOIN leaders n ON n.seq = CASE WHEN r.by_id IS NULL THEN nn.seq ELSE nn.idless END AND n.seq < r.seq""", "identity", "leaders")
_RANK = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(PRECEDENCE)) + " ELSE 99 END"


def _order(field: str) -> str:
    return "seq" if CONTRACT[field].sensitive else f"({_RANK}) * 1000000000000000 + seq"


block("merged", "SELECT entity_seq, arg_min(match_key, seq) AS match_key, "
      "regexp_replace(arg_min(match_key, seq), '^(id|email):', '') AS canonical_key, count(*) AS row_count, " + ", ".join(
          f"arg_min({f}, {_order(f)}) FILTER (WHERE {f} IS NOT NULL) AS {f}, "
          f"arg_min(source, {_order(f)}) FILTER (WHERE {f} IS NOT NULL) AS {f}__source" for f in CONTRACT.names)
      + " FROM staged JOIN links USING (seq) JOIN (SELECT seq, match_key FROM identity) USING (seq) GROUP BY entity_seq",
      "staged", "links", "identity")
block("differing", " UNION ALL ".join(
    f"SELECT m.canonical_key, '{f.name}' AS field, {f.sensitive} AS sensitive, s.{f.name} AS value, m.{f.name} AS winner, "
    f"m.{f.name}__source AS winner_source, s.source, s.row_num, s.seq "
    f"FROM staged s JOIN links l USING (seq) JOIN merged m USING (entity_seq) WHERE s.{f.name} <> m.{f.name}" for f in CONTRACT.fields),
    "staged", "links", "merged")
block("sensitive_conflicts", """
SELECT canonical_key, field, any_value(winner_source) AS kept_source, any_value(winner) AS kept_value,
       arg_min(source, seq) AS other_source, arg_min(value, seq) AS other_value, count(*) AS differing_rows
FROM differing WHERE sensitive GROUP BY canonical_key, field""", "differing")
block("persons", """
SELECT canonical_key, date_of_birth AS block, array_to_string(list_sort(string_split(
         regexp_replace(trim(lower(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))), '\\s+', ' ', 'g'), ' ')), ' ') AS name
FROM merged WHERE date_of_birth IS NOT NULL AND (first_name IS NOT NULL OR last_name IS NOT NULL)""", "merged")
block("near_dups", f"""
SELECT block AS date_of_birth, name_a, name_b, round(similarity, 1) AS similarity, entities_a, entities_b FROM (
  SELECT a.block, a.name AS name_a, b.name AS name_b, {ratio('a.name', 'b.name')} AS similarity, a.n AS entities_a, b.n AS entities_b
  FROM (SELECT block, name, count(*) AS n FROM persons GROUP BY ALL) a
  JOIN (SELECT block, name, count(*) AS n FROM persons GROUP BY ALL) b
    ON a.block = b.block AND (a.name < b.name OR (a.name = b.name AND a.n > 1)))
WHERE similarity >= 90""", "persons")

# -- checks ----------------------------------------------------------------------------------

_EMAIL_OK = "regexp_matches({c}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')"


def errors(value=lambda f: f) -> str:
    checks = []
    for f in CONTRACT.required:
        checks.append(f"CASE WHEN {value(f.name)} IS NULL OR trim({value(f.name)}) = '' THEN 'required:{f.name}' END")
    for f in CONTRACT.of_type("email"):
        checks.append(f"CASE WHEN {value(f.name)} <> '' AND NOT {_EMAIL_OK.format(c=value(f.name))} THEN 'email:{f.name}' END")
    for f in CONTRACT.fields:
        if f.pattern:
            checks.append(f"CASE WHEN {value(f.name)} <> '' AND NOT regexp_matches(trim({value(f.name)}), {quoted(f.anchored_pattern)}) "
                          f"THEN 'pattern:{f.name}' END")
    for f in CONTRACT.of_type("decimal"):
        number = f"TRY_CAST(regexp_replace({value(f.name)}, '[,$]', '', 'g') AS DOUBLE)"
        checks.append(f"CASE WHEN {value(f.name)} <> '' AND {number} IS NULL THEN 'number:{f.name}' END")
        if f.min is not None:
            checks.append(f"CASE WHEN {number} < {f.min} THEN 'minimum:{f.name}' END")
    for f in CONTRACT.of_type("enum"):
        values = ", ".join(quoted(v) for v in f.values)
        checks.append(f"CASE WHEN {value(f.name)} <> '' AND {value(f.name)} NOT IN ({values}) THEN 'enum:{f.name}' END")
    return f"list_filter([{', '.join(checks)}], lambda e: e IS NOT NULL)"


# The amounts of the exports are whole numbers, with or without other text; a negative one stays as it is.
block("checked", f"""
SELECT * EXCLUDE (amount, mends), {errors()} AS errors, CASE WHEN mends THEN 'salary' ELSE '' END AS fixes
FROM (SELECT * REPLACE (CASE WHEN mends THEN CAST(amount AS VARCHAR) || '.0' ELSE salary END AS salary)
      FROM (SELECT *, list_contains(errors_before, 'number:salary') AND amount >= 0 AS mends
            FROM (SELECT *, {errors()} AS errors_before, TRY_CAST(regexp_replace(salary, '[^\\d.\\-]', '', 'g') AS BIGINT) AS amount FROM merged)))""",
      "merged")
block("canonical", """
SELECT *, 'run_0' AS run_id, CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'quarantined' END AS outcome,
       CASE WHEN len(errors) = 0 THEN 'ready' ELSE 'quarantined' END AS status FROM checked""", "checked")
