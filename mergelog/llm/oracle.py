"""The operators' queries that SQL can express, as DuckDB SQL."""

from .chat import CLOSE, CONTROLS, OPEN, ROLE, ROLE_END

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _shingles(words: str, key: str, text: str, table: str, name: str) -> str:
    """name(key, i, s): runs of five words from place i; of fewer words, the whole."""
    return f"""{words} AS (SELECT {key}, regexp_extract_all({text}, {WORD}) AS ws FROM {table}),
  {name} AS (SELECT {key}, i, array_to_string(ws[i:i + 4], ' ') AS s FROM {words}, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i) WHERE len(ws) >= 5
    UNION ALL SELECT {key}, 1, array_to_string(ws, ' ') FROM {words} WHERE len(ws) BETWEEN 1 AND 4)"""


NEAR = f"""WITH RECURSIVE {_shingles('w', 'doc_id', f"translate(coalesce(text, ''), {UPPER})", 'documents', 'every')},
  sh AS (SELECT DISTINCT doc_id, s FROM every), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM sh GROUP BY doc_id),
  c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
  r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
  m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.y, d.doc_id) AS kept
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id"""

REPEATS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
  v AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 11)) AS i) WHERE len(ws) >= 13),
  g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM v JOIN (SELECT s, min(doc_id) AS m FROM v GROUP BY s) USING (s) WHERE m < doc_id),
  k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.k) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w) p
    ANTI JOIN g ON g.doc_id = p.doc_id AND g.k = p.k GROUP BY p.doc_id),
  r AS (SELECT doc_id, count(*)::BIGINT AS r FROM g GROUP BY doc_id)
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


FIXED = len(OPEN + ROLE + ROLE_END + CLOSE)
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({FIXED} + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
  SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

LEAKS = f"""WITH {_shingles('dw', 'doc_id', "lower(coalesce(text, ''))", 'documents', 'ds')}, {_shingles('iw', 'item_id', "lower(coalesce(text, ''))", 'benchmark', 'si')},
  ic AS (SELECT item_id, s, count(*) AS c FROM si GROUP BY ALL), ik AS (SELECT item_id, count(*) AS k FROM si GROUP BY ALL), dk AS (SELECT doc_id, count(*) AS k FROM ds GROUP BY ALL),
  pr AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN ic USING (s)),
  st AS (SELECT doc_id, item_id, ik.k, least(ik.k, dk.k) AS size, unnest(range(1, greatest(dk.k - ik.k, 0) + 2)) AS a FROM pr JOIN ik USING (item_id) JOIN dk USING (doc_id)),
  sm AS (SELECT st.doc_id, st.item_id, k, size, a, ds.s, least(count(*), any_value(ic.c)) AS m FROM st JOIN ds ON ds.doc_id = st.doc_id AND ds.i BETWEEN a AND a + k - 1 JOIN ic ON ic.item_id = st.item_id AND ic.s = ds.s GROUP BY ALL),
  jc AS (SELECT doc_id, item_id, sum(m) AS shared, any_value(k + size) AS total FROM sm GROUP BY doc_id, item_id, a),
  ht AS (SELECT doc_id, item_id, max(shared::DOUBLE / (total - shared)::DOUBLE) AS similarity FROM jc WHERE 100 * shared >= 75 * (total - shared) GROUP BY doc_id, item_id),
  bd AS (SELECT doc_id, max(similarity) AS similarity, array_to_string(list(item_id ORDER BY item_id), ',') AS items FROM ht GROUP BY doc_id)
  SELECT d.doc_id, bd.doc_id IS NOT NULL AS contaminated, bd.doc_id IS NULL AS kept, coalesce(similarity, 0.0::DOUBLE) AS similarity, coalesce(items, '') AS items FROM documents d LEFT JOIN bd USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": NEAR,
    "op4_repeats": REPEATS,
    "op5_chat": CHAT,
    "op10_decontaminate": LEAKS,
}
