"""SQL of the queries that SQL can express."""

from __future__ import annotations

from stargauge.llm.chat import END, PLAIN, SEPARATOR, START
from stargauge.llm.decontaminate import AROUND, LEAST_EQUAL, MASKS, SPAN

CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
  FROM range(2) t(i)
),
clean AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    regexp_replace(coalesce(text, ''), '{PLAIN}', '\1\\\2\3', 'g') AS escaped,
    regexp_replace(coalesce(role, ''), '{PLAIN}', '\1\\\2\3', 'g') AS escaped_role,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM turns
),
marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY place)
    OR place = 1 AS starts
  FROM clean
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), ''))
    AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN starts
    THEN {len(START) + len(SEPARATOR) + len(END)} + length(escaped_role)
    ELSE {len(SEPARATOR)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

WARC_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest
  FROM pages
),
grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM grouped
"""

TOP_K_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def _decontamination_sql() -> str:
    def key(mask: str) -> str:
        return " || '|' || ".join(
            f"w[i + {at + 1}]" for at in range(SPAN) if mask[at] == "1"
        )

    keys = ", ".join(f"'{n}|' || {key(mask)}" for n, mask in enumerate(MASKS))
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH docs AS (SELECT doc_id, {words} AS w FROM documents),
items AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
doc_places AS (SELECT doc_id, w, unnest(range(len(w) - {SPAN - 1})) AS i FROM docs WHERE len(w) >= {SPAN}),
item_places AS (SELECT item_id, w, unnest(range(len(w) - {SPAN - 1})) AS i FROM items WHERE len(w) >= {SPAN}),
doc_seeds AS (SELECT doc_id, i, unnest([{keys}]) AS seed FROM doc_places),
item_seeds AS (SELECT item_id, i, unnest([{keys}]) AS seed FROM item_places),
hits AS (
  SELECT d.doc_id, s.item_id, d.i AS place, s.i AS item_place
  FROM doc_seeds d JOIN item_seeds s ON d.seed = s.seed
),
spans AS (
  SELECT h.*, docs.w AS doc, items.w AS item, least(len(items.w), {AROUND}) AS compared,
    greatest(0, least(item_place - {(AROUND - SPAN) // 2},
      len(items.w) - least(len(items.w), {AROUND}))) AS start
  FROM hits h JOIN docs ON h.doc_id IS NOT DISTINCT FROM docs.doc_id
    JOIN items ON h.item_id IS NOT DISTINCT FROM items.item_id
),
counted AS (
  SELECT doc_id, item_id, compared, len(list_filter(range(start, start + compared),
    lambda p: place - item_place + p >= 0
      AND coalesce(doc[place - item_place + p + 1] = item[p + 1], false))) AS equal
  FROM spans
)
SELECT doc_id, item_id, CAST(max(equal) AS INTEGER) AS equal,
  CAST(max(compared) AS INTEGER) AS compared
FROM counted WHERE equal >= ceil(compared * {LEAST_EQUAL})
GROUP BY doc_id, item_id
"""


DECONTAMINATION_SQL = _decontamination_sql()

RANKED_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
items AS (
  SELECT row_number() OVER () AS row, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
whole AS (
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS l
  FROM docs WHERE len(terms) > 0
),
held AS (
  SELECT row, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM held CROSS JOIN whole GROUP BY term, n
),
norms AS (
  SELECT row, doc_id, 100 - 25 + ((25 * CAST(len(terms) AS BIGINT) * n) // l) AS m
  FROM docs CROSS JOIN whole WHERE len(terms) > 0
),
asked AS (SELECT row AS item, item_id, term, count(*) AS times FROM items GROUP BY ALL),
scored AS (
  SELECT item, item_id, norms.row, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN norms ON norms.row = held.row
  GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM scored WHERE score > 0
) WHERE rank <= 20
"""
