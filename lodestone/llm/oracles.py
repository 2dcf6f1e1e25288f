"""DuckDB SQL for the queries that SQL can express."""

OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce('=' || role, '-') AS r, coalesce('=' || text, '-') AS x,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
), c AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, md5(r), md5(x)) AS turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, md5(r), md5(x)) AS shown
  FROM t GROUP BY conv_id
), u AS (
  SELECT min(conv_id) AS conv_id, turns, min(shown) AS shown, count(*) AS n FROM c GROUP BY turns
), prefixes AS (
  SELECT DISTINCT turns[1:k] AS p FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM u)
)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, CAST(n AS BIGINT) AS n_copies, shown AS text
FROM u ANTI JOIN prefixes ON u.turns = prefixes.p
"""

OP5 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), d AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, (d.key IS NOT NULL AND k.doc_id <> d.last) AS dropped FROM k LEFT JOIN d USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP6 = r"""
WITH z AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS w
  FROM z GROUP BY source
), f AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(3 * source_size AS DOUBLE) / w AS fill FROM p
), lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM f
), fin AS (
  SELECT min({'fill': fill, 'lvl': lvl}) AS m FROM lv WHERE lvl <= fill
), t AS (
  SELECT source, source_size, docs, CASE WHEN fill < m.fill THEN cap ELSE least(cap, w * m.lvl) END AS target FROM lv, fin
), a AS (
  SELECT z.doc_id, z.source, z.size, t.source_size, t.target,
         CAST(floor(1024 * z.size / greatest(z.size + CAST(floor(t.source_size / greatest(t.docs, 1)) AS BIGINT), 1)) AS BIGINT) AS tq
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, CAST(sum(tq * size) OVER s AS DOUBLE) / greatest(CAST(sum(size) OVER s AS DOUBLE), 1) AS tm,
         target / greatest(source_size, 1) AS rho FROM a WINDOW s AS (PARTITION BY source)
), e AS (
  SELECT *, greatest(least(rho + 0.5::DOUBLE * least(rho, 3 - rho) * (tq - tm) / 1024, 3.0::DOUBLE), 0.0::DOUBLE) AS e,
         (CAST(('0x' || substr(md5('20|' || coalesce('=' || doc_id, '-')), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM b
), q AS (
  SELECT *, floor(e) AS whole, CASE WHEN e - floor(e) > 0 AND size > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM e
), r AS (
  SELECT *, sum(whole * size) OVER (PARTITION BY source) AS certain,
         sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up FROM q
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((whole + CASE WHEN q IS NOT NULL AND 2 * up - size <= 2 * (target - certain) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""

ORACLES: dict[str, str] = {"op4_chat": OP4, "op5_line_dedup": OP5, "op6_mixing": OP6}

OP3 = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a * b FOR a, b IN e]) AS BIGINT) AS score FROM v q, v c
  WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""".replace("list_sum([a * b FOR a, b IN e])", "list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[]))")

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
         ELSE [w[i:i + 4] FOR i IN range(1, len(w) - 3)] END)) AS g FROM d
), h AS (
  SELECT doc_id, md5(array_to_string(g, ' ')) AS g FROM s
), n AS (
  SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM i JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), c(node, reached) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT c.node, l.y FROM c JOIN l ON c.reached = l.x
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id, d.doc_id = min(reached) AS kept
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLES |= {"op3_vector_search": OP3, "op7_near_dup": OP7}
