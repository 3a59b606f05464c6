"""Check SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

# Words of a document: each (source, doc_id) once, with the words of all its rows.
UNITS = """
units AS MATERIALIZED (SELECT coalesce(source, '') AS source, doc_id, sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0))::BIGINT AS n
                       FROM documents GROUP BY 1, 2),
src AS MATERIALIZED (SELECT source, sum(n)::BIGINT AS t FROM units GROUP BY 1 HAVING sum(n) > 0),
shares AS MATERIALIZED (SELECT list(t / total ORDER BY source) AS ps, count(*) AS k FROM src, (SELECT sum(t)::DOUBLE AS total FROM src)),
"""

# Bisection of the exponent between 0 and 1; {up} tells whether the middle ``a`` is still too low.
BISECT = """
bisect(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN up THEN a ELSE lo END, CASE WHEN up THEN hi ELSE a END
  FROM (SELECT step, lo, hi, a, {up} AS up FROM (SELECT step, lo, hi, (lo + hi) / 2 AS a, ps, k FROM bisect, shares WHERE step < 48))),
expo AS MATERIALIZED (SELECT CASE WHEN (SELECT count(*) FROM src) < 2 THEN 1.0 ELSE round({end}, 9) END AS a FROM bisect WHERE step = 48),
"""
ENTROPY_UP = ("ln(list_sum(list_transform(ps, lambda p: pow(p, a)))) - a * list_sum(list_transform(ps, lambda p: pow(p, a) * ln(p)))"
              " / list_sum(list_transform(ps, lambda p: pow(p, a))) >= {entropy} * ln(k::DOUBLE)")

MIXTURE = """
w0 AS (SELECT source, t, pow(t / (SELECT sum(t)::DOUBLE FROM src), a) AS w FROM src, expo),
w1 AS (SELECT source, t, w / (SELECT sum(w) FROM w0) AS weight FROM w0),
w2 AS MATERIALIZED (SELECT source, t, weight, round(weight * (SELECT max(t / weight) FROM w1))::BIGINT AS own FROM w1),
mixture AS MATERIALIZED (SELECT source, weight, own // t AS epochs, own % t AS lft FROM w2),
taken AS MATERIALIZED (
  SELECT u.source, u.doc_id, u.n, m.weight,
         coalesce(m.epochs, 1) + CASE WHEN m.lft > 0 AND sum(u.n) OVER (PARTITION BY u.source ORDER BY md5(m.epochs || ':' || coalesce(u.doc_id::VARCHAR, ''))
                                                                     ROWS UNBOUNDED PRECEDING) - u.n < m.lft THEN 1 ELSE 0 END AS copies
  FROM units u LEFT JOIN mixture m USING (source))
"""


def mixing(entropy: float) -> str:
    return "WITH RECURSIVE" + UNITS + BISECT.format(up=ENTROPY_UP.format(entropy=entropy), end="lo") + MIXTURE + """
SELECT d.doc_id, coalesce(d.source, '') AS source, e.epoch, md5(e.epoch || ':' || coalesce(d.doc_id::VARCHAR, '')) AS place
FROM documents d JOIN taken k ON coalesce(d.source, '') = k.source AND d.doc_id IS NOT DISTINCT FROM k.doc_id,
     LATERAL (SELECT unnest(range(k.copies::BIGINT))::INTEGER AS epoch) e
"""


def decontamination(masks: tuple[str, ...], min_words: int, similarity: float, match: int, miss: int) -> str:
    """Overlaps of documents and benchmark items by spaced seeds, with windows of words joined on their text."""
    span = max(map(len, masks))
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY {{by}} ORDER BY pos) AS w{k}" for k in range(1, span))
    keys = []
    for number, mask in enumerate(masks):
        used = [f"{{t}}w{k or ''}" for k, bit in enumerate(mask) if bit == "1"]
        keys.append(f"SELECT *, {number} || ' ' || " + " || ' ' || ".join(used).format(t="") + f" AS seed FROM {{of}} WHERE {used[-1].format(t='')} IS NOT NULL")

    def seeds(of: str) -> str:
        return " UNION ALL ".join(k.format(of=of) for k in keys)

    words = "list_filter(string_split(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {words.format('text')} AS ws FROM documents),
items AS MATERIALIZED (SELECT DISTINCT item_id, {words.format('text')} AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
iw AS MATERIALIZED (SELECT item_id, len(ws) AS item_words, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM items),
dl AS MATERIALIZED (SELECT *, {leads.format(by='doc_id')} FROM dw),
il AS MATERIALIZED (SELECT *, {leads.format(by='item_id')} FROM iw),
ds AS ({seeds('dl')}), bs AS ({seeds('il')}),
hits AS MATERIALIZED (SELECT DISTINCT ds.doc_id, bs.item_id, bs.item_words, ds.pos - bs.pos AS start FROM ds JOIN bs USING (seed)),
laid AS (SELECT h.doc_id, h.item_id, h.item_words, h.start, iw.pos, (iw.w = dw.w)::INT AS same
         FROM hits h JOIN iw USING (item_id) JOIN dw ON dw.doc_id = h.doc_id AND dw.pos = h.start + iw.pos),
sums AS MATERIALIZED (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, start ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM laid),
-- every stretch that is long enough
rated AS (SELECT e.doc_id, e.item_id, e.item_words, (e.pos - b.pos + 1)::INTEGER AS overlap_words, (e.s - b.s + b.same)::INTEGER AS matched_words,
                 ({match} - ({miss})) * (e.s - b.s + b.same) + ({miss}) * (e.pos - b.pos + 1) AS score
          FROM sums b JOIN sums e ON b.doc_id IS NOT DISTINCT FROM e.doc_id AND b.item_id = e.item_id AND b.start = e.start AND e.pos - b.pos + 1 >= least({min_words}, e.item_words)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, overlap_words DESC, matched_words DESC) AS r FROM rated
        WHERE matched_words >= {similarity} * overlap_words)
SELECT doc_id, item_id, overlap_words, matched_words, matched_words / overlap_words AS similarity FROM top WHERE r = 1
"""

CHAT = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
spelled AS (SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, chr(92), chr(92) || '-'), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n')) + 1
                      + length(replace(replace(text, chr(92), chr(92) || '-'), '<|', '<' || chr(92) || '|')) + length('<|im_end|>') + 1 AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM spelled GROUP BY conv_id
"""

NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM ok q, ok c
          WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# Unsigned crc32 of a decimal id: the register starts with all ones, takes each byte and is shifted eight times.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({id}::VARCHAR, ''),
  lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""

_FIELD = "coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_WALK = """SELECT w.id, w.doc_id, w.leaf, w.g, w.level + 1, w.pos // 3, sha256(array_to_string(s.hs[1:w.pos % 3], '') || w.folded || array_to_string(s.hs[w.pos % 3 + 2:], '')),
         w.proof || array_to_string(s.hs[1:w.pos % 3], '') || array_to_string(s.hs[w.pos % 3 + 2:], '')"""
MERKLE = f"""
WITH RECURSIVE
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS g, {_LEAF.format(text="text")} AS leaf,
         CASE WHEN {CRC32.format(id="doc_id")} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS shown
  FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM docs),
tree AS (
  SELECT g, 0 AS level, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, level, pos // 3),
runs AS MATERIALIZED (SELECT g, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY ALL),
subs AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
toptree AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subs
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 2) // 3 FROM toptree WHERE n > 1 GROUP BY level, pos // 3),
topruns AS MATERIALIZED (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM toptree WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT id, doc_id, leaf, g, 0 AS level, pos, shown AS folded, '' AS proof FROM placed
  UNION ALL
  {_WALK} FROM walk w JOIN runs s ON s.g = w.g AND s.level = w.level AND s.run = w.pos // 3),
atsub AS MATERIALIZED (SELECT w.*, subs.subroot, subs.pos AS subpos FROM walk w JOIN subs USING (g)
                       WHERE w.level = (SELECT max(t.level) FROM tree t WHERE t.g = w.g)),
topwalk AS (
  SELECT id, doc_id, leaf, subroot AS g, 0 AS level, subpos AS pos, folded, proof FROM atsub
  UNION ALL
  {_WALK} FROM topwalk w JOIN topruns s ON s.level = w.level AND s.run = w.pos // 3)
SELECT doc_id, leaf, g AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM topwalk, (SELECT h AS root FROM toptree WHERE n = 1) WHERE level = (SELECT max(level) FROM toptree)
"""

FILTER_AUDIT = """
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
masks AS MATERIALIZED (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
cells AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY 1, 2),
grown AS (SELECT '' AS o UNION ALL SELECT o || x FROM grown, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(o, x)),
steps AS MATERIALIZED (SELECT o, s::INTEGER AS step, o[s:s] AS own, o[1:s - 1] AS earlier FROM grown, range(1, 6) AS r(s) WHERE length(o) = 5),
cases AS MATERIALIZED (
  SELECT part, o, step, own, n, good, toxic, fails, contains(fails, own) AS f, len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND fails <> '' AS gone
  FROM cells, steps),
rows AS MATERIALIZED (
  SELECT part, o AS filter_order, step, own, coalesce(sum(n) FILTER (NOT f AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (f AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (f AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (f AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (f AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM cases GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM rows
"""
