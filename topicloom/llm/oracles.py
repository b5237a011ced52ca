"""DuckDB SQL of the queries whose results SQL can state."""

from __future__ import annotations

from .line_dedup import MIN_WORDS

_LINK_STEPS = """
reach(node, label) AS (
    SELECT node, node FROM nodes
    UNION
    SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.node WHERE reach.label < links.b
),
labels AS (SELECT node, min(label) AS component_id FROM reach GROUP BY 1)
"""

#: Lines that repeat an earlier one, in all words or in all but one edit.
LINE_DEDUP = rf"""
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, pos, line, trim(regexp_replace(lower(line), '[ \t\r\x0b\x0c]+', ' ', 'g')) AS words FROM split),
first_ones AS (SELECT words, min((doc_id, pos)) AS p, string_split(words, ' ') AS w FROM lines WHERE words <> '' GROUP BY words),
numbered AS (SELECT row_number() OVER (ORDER BY p) AS i, words, w, len(w) AS n, p FROM first_ones),
places AS (SELECT i, w, n, unnest(range(1, n + 1)) AS k FROM numbered WHERE n >= {MIN_WORDS - 1}),
less AS (SELECT i, n, k, array_to_string(list_concat(w[1:k - 1], w[k + 1:]), ' ') AS rest FROM places),
replaced AS (SELECT i, min(i) OVER (PARTITION BY n, k, rest) AS earliest FROM less WHERE n >= {MIN_WORDS}),
shorter AS (SELECT a.i AS one, b.i AS other FROM less a JOIN numbered b ON a.n >= {MIN_WORDS} AND b.n = a.n - 1 AND a.rest = b.words),
near AS (SELECT i FROM replaced WHERE earliest < i UNION SELECT greatest(one, other) FROM shorter),
kept AS (SELECT p FROM numbered WHERE i NOT IN (SELECT i FROM near)),
marked AS (SELECT doc_id, pos, line, words = '' AS blank, words <> '' AND (doc_id, pos) IN (SELECT p FROM kept) AS kept FROM lines)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, CASE WHEN d.text IS NOT NULL THEN coalesce(m.text, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count_if(NOT blank)::bigint AS n_lines, count_if(kept)::bigint AS n_kept, string_agg(line, chr(10) ORDER BY pos) FILTER (blank OR kept) AS text FROM marked GROUP BY 1) m USING (doc_id)
"""

#: Exact similarities of the sets of five-word shingles, and components by the least doc_id that reaches a document.
MINHASH = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS found FROM docs),
sized AS (SELECT doc_id, len(found)::bigint AS n_shingles FROM shingled),
elements AS (SELECT doc_id, md5(unnest(found)) AS shingle FROM shingled),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM elements a JOIN elements b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * n >= 85 * (x.n_shingles + y.n_shingles - n)),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
nodes AS (SELECT doc_id AS node FROM documents),
{_LINK_STEPS}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN labels ON node = doc_id
"""

#: Exact cosines of all pairs.
EMBEDDING_DEDUP = f"""
WITH RECURSIVE sound AS (SELECT vec_id, embedding::double[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_LINK_STEPS}
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component_id, node = component_id AS kept FROM labels
"""

#: Groups placed one by one; the checksum is computed byte by byte.
SHARDING = r"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS entries),
docs AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS k, hex(encode(coalesce(text, ''))) AS digits FROM documents),
sums AS (SELECT k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(any_value(size) - 1), lambda j: ('0x' || substr(any_value(digits), 2 * j + 1, 2))::bigint)), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM docs, crc_table GROUP BY k, entries),
groups AS (SELECT k, sum(size)::bigint AS size, row_number() OVER (ORDER BY sum(size) DESC, k) AS i FROM docs GROUP BY k),
steps(i, room, shard) AS (
    SELECT 0::bigint, list_resize([]::bigint[], 8, share), NULL::int FROM (SELECT ((sum(size) + 7) // 8)::bigint AS share FROM docs)
    UNION ALL
    SELECT i, list_transform(room, lambda r, s: CASE WHEN s = shard + 1 THEN r - size ELSE r END), shard
    FROM (SELECT g.i, room, size, (list_position(room, coalesce(list_min(list_filter(room, lambda r: r >= size)), list_max(room))) - 1)::int AS shard FROM steps JOIN groups g ON g.i = steps.i + 1)
)
SELECT doc_id, docs.size::bigint AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, docs.size) - 1 AS slot, NULL::int AS grown_shard
FROM docs JOIN sums USING (k) JOIN groups USING (k) JOIN steps USING (i)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP, "op5_minhash": MINHASH, "op8_embedding_dedup": EMBEDDING_DEDUP, "op9_sharding": SHARDING}
