"""DuckDB SQL of the corpus queries that SQL can express."""

#: CRC-32 (reflected polynomial 0xEDB88320, a fixed value) over the bytes of a text.
_CRC = """tab AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS n))),
bytes AS (SELECT doc_id, source, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
crc AS (SELECT doc_id, source, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])))::BIGINT AS text_crc32 FROM bytes, tab)"""

OP2 = f"""
WITH {_CRC},
r AS (SELECT *, count(*) OVER () AS n, (2 * row_number() OVER (PARTITION BY source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, '')), doc_id, text_crc32) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS f FROM crc),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS LAST) - 1 AS i FROM r)
SELECT doc_id, octet_length(encode(text)) + 8 AS size, text_crc32, 'rows' AS law, (i * 24 // n)::INTEGER AS shard,
       i - ((i * 24 // n) * n + 23) // 24 AS slot, NULL::INTEGER AS grown_shard
FROM p"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('23:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
q AS (SELECT source, sum(size)::BIGINT AS c FROM d GROUP BY source),
s AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM q),
o AS (SELECT *, (3 * c)::DOUBLE AS cap, (sum(c) OVER ())::DOUBLE AS total, coalesce(sum((3 * c)::DOUBLE) OVER (ORDER BY 3 * c / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
             sum(w) OVER (ORDER BY 3 * c / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM s),
f AS (SELECT *, cap * lft <= w * (total - gone) AS sat FROM o),
g AS (SELECT *, coalesce(sum(cap) FILTER (sat) OVER (), 0) AS gone2, sum(w) FILTER (NOT sat) OVER () AS lft2 FROM f),
t AS (SELECT source, c, round(CASE WHEN sat THEN cap ELSE w * (total - gone2) / lft2 END, 6) AS target FROM g),
b AS (SELECT d.*, c, target, CASE WHEN c > 0 THEN least(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 4096 // c, 4095) ELSE 0 END AS block FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT source, block, c, target, sum(size)::BIGINT AS wrd FROM b GROUP BY source, block, c, target),
v AS (SELECT *, sum(wrd) OVER (PARTITION BY source ORDER BY block) - wrd AS pre FROM x),
y AS (SELECT *, CASE WHEN c > 0 THEN least(floor(target / c), 3) ELSE 0 END AS full_epochs FROM v),
z AS (SELECT source, block, full_epochs + (CASE WHEN pre + wrd / 2 <= target - full_epochs * c AND full_epochs < 3 THEN 1 ELSE 0 END) AS times FROM y)
SELECT doc_id, size, c AS source_size, target, (size * times)::BIGINT AS taken FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source AND b.block = z.block"""

OP9 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS g FROM (SELECT *, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, size, p, array_to_string(w[p:p + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT r, p, dw.size, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.size = iw.size),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM h) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS n_items, coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '') AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)"""

OP8 = r"""
WITH l AS (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(0, len(string_split(text, chr(10)))))) AS z, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
ll AS (SELECT doc_id, z[1] AS x, (coalesce(list_sum(list_transform(a[1:z[2]], lambda y: length(y) + 1)), 0))::BIGINT AS start FROM l),
s AS (SELECT doc_id, start AS base, unnest(list_zip(string_split(x, '. '), range(0, len(string_split(x, '. '))))) AS z, string_split(x, '. ') AS a FROM ll WHERE contains(x, '. ') AND rtrim(trim(regexp_replace(lower(x), '\s+', ' ', 'g')), '.') <> ''),
u AS (SELECT doc_id, 'line' AS unit, x, start FROM ll UNION ALL SELECT doc_id, 'sentence', z[1], base + (coalesce(list_sum(list_transform(a[1:z[2]], lambda y: length(y) + 2)), 0))::BIGINT FROM s),
n AS (SELECT doc_id, unit, start, start + length(x) AS stop, rtrim(trim(regexp_replace(lower(x), '\s+', ' ', 'g')), '.') AS k FROM u),
w AS (SELECT *, len(string_split(k, ' '))::INTEGER AS n_words FROM n WHERE k <> ''),
f AS (SELECT *, first_value(doc_id) OVER g AS gd, first_value(start) OVER g AS gs, first_value(start) OVER (PARTITION BY k, doc_id ORDER BY start) AS own FROM w WINDOW g AS (PARTITION BY k ORDER BY doc_id, start))
SELECT doc_id, unit, start::INTEGER AS start, stop::INTEGER AS "end", n_words, gd AS first_doc_id, gs::INTEGER AS first_start
FROM f WHERE own <> start OR gd <> doc_id"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT r, doc_id, p, a[p] AS x, translate(trim(a[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT *, unnest(range(1, len(a) + 1)) AS p FROM d)),
g AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= 2),
m AS (SELECT l.*, coalesce(g.keeper IS NOT NULL AND l.doc_id IS DISTINCT FROM g.keeper, false) AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""


def _lloyd(rounds: int = 10, k: int = 8) -> str:
    """Rounds of exact assignment and floored means, one after the other."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INTEGER AS k, x AS c FROM v QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, x, k, d FROM (SELECT *, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT k, p, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM a{i}) GROUP BY k, p)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(f, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS f FROM m{i} GROUP BY k) AS q ON c{i}.k = q.k)")
    parts.append(f"i AS (SELECT k, sum(d)::BIGINT AS own, (sum(sum(d)) OVER ())::BIGINT AS every FROM a{rounds} GROUP BY k)")
    last = f"SELECT vec_id, a.k AS cluster, d AS distance, own AS cluster_inertia, every AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN i ON a.k = i.k JOIN c{rounds} AS c ON a.k = c.k"
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = {"op11_clustering": _lloyd(), "op13_line_dedup": OP13, "op8_substrings": OP8, "op2_sharding": OP2, "mixing_quotas": OP6, "op9_decontamination": OP9}
