"""DuckDB SQL for the operators that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The pages here hold one article each, and no white space or references beyond these.
PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '<[a-zA-Z/][^>]*$', ''), '</?b>', '', 'g'), '</?[a-z][^>]*>', ' ', 'g') AS x FROM a),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS t FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(t), 10) AS w,
             unnest(list_transform(range(1, greatest(len(t) - 8, 2)), lambda i: array_to_string(t[i:i + 9], ' '))) AS k FROM b WHERE len(t) > 0),
d AS (SELECT doc_id, {_ALNUM} AS t FROM documents),
n AS (SELECT doc_id, w, list_transform(range(1, len(t) - w + 2), lambda i: array_to_string(t[i:i + w - 1], ' ')) AS ks
      FROM d, (SELECT DISTINCT w FROM p)),
o AS (SELECT doc_id, w, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS i FROM n WHERE len(ks) > 0),
h AS (SELECT o.doc_id, o.i, o.w, p.item_id FROM o JOIN p ON p.w = o.w AND p.k = o.k),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS q FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id"""

WINDOWS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents),
l AS (SELECT doc_id, list_transform(range(1, len(t) - 18), lambda i: array_to_string(t[i:i + 19], ' ')) AS ks FROM d),
o AS (SELECT doc_id, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS i FROM l WHERE len(ks) > 0),
r AS (SELECT doc_id, i FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
w AS (SELECT doc_id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS p FROM d WHERE len(t) > 0),
k AS (SELECT w.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN x END, ' ' ORDER BY w.p) AS kept
      FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(t) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

_ESCAPED = r"length(regexp_replace(replace({0}, '\', '\\'), '(<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\[TEXT\])', 'x\1', 'g'))"

CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, {_ESCAPED.format('text')} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
                ELSE 19 + {_ESCAPED.format('role')} END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


#: The CRC-32 of ISO 3309 over the ASCII bytes of a decimal number; its polynomial, reflected, is a fixed value.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda x, b: list_reduce(list_prepend(xor(x, b), [1::UBIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::UBIGINT))))"""


def _levels(p: str, depth: int) -> str:
    """CTEs of a forest over {p}0 (s, i, h): runs {p}r{k} of 16 with their list, nodes {p}{k + 1}; a single node stays."""
    return ",\n".join(f"""{p}r{k} AS (SELECT s, i // 16 AS j, list(h ORDER BY i) AS hs, count(*) OVER (PARTITION BY s) = 1 AND count(*) = 1 AS single FROM {p}{k} GROUP BY s, i // 16),
{p}{k + 1} AS (SELECT s, j AS i, CASE WHEN single THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {p}r{k})""" for k in range(depth))


def _fold(p: str, f: str, depth: int) -> str:
    """CTEs that carry (key, s, i, cur, proof) from {f}0 up all runs."""
    left, right = "array_to_string(hs[1:i % 16], '')", "array_to_string(hs[i % 16 + 2:], '')"
    return ",\n".join(f"""{f}{k + 1} AS (SELECT key, f.s, f.i // 16 AS i, CASE WHEN single THEN cur ELSE sha256({left} || cur || {right}) END AS cur,
  CASE WHEN single THEN proof ELSE proof || {left} || {right} END AS proof FROM {f}{k} f JOIN {p}r{k} r ON r.s = f.s AND r.j = f.i // 16)""" for k in range(depth))


#: Sources of up to 16^4 rows, up to 16^3 sources.
MERKLE = f"""
WITH d AS (SELECT *, doc_id IS NOT NULL AND {_CRC32} % 5 = 0 AS bad FROM documents),
v AS (SELECT doc_id, source, sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
  CASE WHEN bad THEN sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS other FROM d),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS key FROM v),
a0 AS (SELECT s, i, leaf AS h FROM l),
{_levels('a', 4)},
b0 AS (SELECT 0 AS s, s - 1 AS i, h FROM a4),
{_levels('b', 3)},
f0 AS (SELECT key, s, i, coalesce(other, leaf) AS cur, '' AS proof FROM l),
{_fold('a', 'f', 4)},
g0 AS (SELECT key, 0 AS s, s - 1 AS i, cur, proof FROM f4),
{_fold('b', 'g', 3)}
SELECT doc_id, leaf, a4.h AS subroot, b3.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = b3.h AS verified
FROM l JOIN g3 USING (key) JOIN a4 ON a4.s = l.s CROSS JOIN b3"""

EXACT = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t, row_number() OVER () AS r FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, r) = 1 AS kept FROM d)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM g"""

COLLOCATIONS = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) v(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
x AS (SELECT s.lang, s.phrase, cut, a, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM s JOIN n ON n.lang = s.lang JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, w, k, unnest(range(1, k)) AS first FROM c WHERE k > 2),
o AS (SELECT lang, a, w, k, first, unnest(range(2, least(k - 1, k - first + 1) + 1)) AS size FROM i),
m AS (SELECT lang, array_to_string(w[first:first + size - 1], ' ') AS phrase, max(a) AS most FROM o GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000"""
