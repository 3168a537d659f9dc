"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

URL_FILTER = r"""
WITH split AS (
  SELECT page_id,
         coalesce(CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) END, '') AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
), patterned AS (
  SELECT *, CASE WHEN regexp_matches(host || path, '^[^/]*\bspam\b') THEN 'spam host'
                 WHEN regexp_matches(host || path, '^[^/]*\bcasino\b') THEN 'casino host'
                 END AS hosts,
         CASE WHEN regexp_matches(host || path, '\.(?:exe|zip|gz|jpe?g|png|mp4)$') THEN 'binary file'
              WHEN regexp_matches(host || path, '/calendar/\d{4}/\d{1,2}\b') THEN 'calendar'
              END AS first_names,
         CASE WHEN regexp_matches(host || path, '/feed/?$') THEN 'feed' END AS feeds
  FROM parts
)
SELECT page_id, host, path, fits.rule,
       coalesce(fits.verdict,
                CASE WHEN coalesce(first_names, hosts, feeds) IS NOT NULL THEN 'block' END,
                'allow') AS verdict,
       CASE WHEN fits.rule IS NULL THEN
            least(first_names, CASE WHEN hosts = 'casino host' THEN hosts END, feeds, hosts)
            END AS pattern
FROM patterned LEFT JOIN fits USING (page_id)
"""

EXACT_TOPK = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.v, c.v)::BIGINT AS score
  FROM kept q, kept c
  WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n
  FROM scores
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 10
"""

WARC = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), digests AS (
  SELECT page_id, octet_length(encode(payload)) AS n, sha256(payload) AS digest FROM sized
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM digests
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to,
       CASE WHEN n < 100 OR first_id = page_id THEN true END AS valid
FROM firsts
"""



def _fill(source: str, parents: str, level: str) -> str:
    family = f"PARTITION BY {parents}" if parents else ""
    keys = f"{parents}, {level}" if parents else level
    return f"""
    SELECT {keys}, CASE WHEN whole THEN cap
                        ELSE least(((given - coalesce(used, 0))::HUGEINT * weight // spare)::BIGINT, cap)
                   END AS given
    FROM (SELECT *, sum(CASE WHEN whole THEN cap END) OVER fam AS used,
                 sum(CASE WHEN NOT whole THEN weight END) OVER fam AS spare
          FROM (SELECT *, cap::HUGEINT * rest <= (given - coalesce(earlier, 0))::HUGEINT * weight AS whole
                FROM (SELECT *, sum(cap) OVER (fam ORDER BY cap / weight, {level}
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
                             sum(weight) OVER (fam ORDER BY cap / weight, {level}
                                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
                      FROM {source} WINDOW fam AS ({family})))
          WINDOW fam AS ({family}))"""


MIXING = f"""
WITH tokens AS (
  SELECT doc_id, 'd' || (regexp_extract(source, '[0-9]+')::BIGINT % 3) AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap
  FROM tokens GROUP BY ALL
), c1 AS (
  SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'd0' THEN 2 ELSE 1 END AS weight,
         (SELECT sum(tokens)::BIGINT * 90 // 100 FROM leaves) AS given
  FROM leaves GROUP BY domain
), b1 AS ({_fill("c1", "", "domain")}
), c2 AS (
  SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 2 ELSE 1 END AS weight,
         any_value(given) AS given
  FROM leaves JOIN b1 USING (domain) GROUP BY domain, lang
), b2 AS ({_fill("c2", "domain", "lang")}
), c3 AS (
  SELECT domain, lang, source, cap, 1 AS weight, given FROM leaves JOIN b2 USING (domain, lang)
), b3 AS ({_fill("c3", "domain, lang", "source")}
), plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs,
         CASE WHEN tokens > 0 THEN given % tokens ELSE -1 END AS rest
  FROM leaves JOIN b3 USING (domain, lang, source)
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
                                ORDER BY md5('0:' || (epochs + 1) || ':' || doc_id), doc_id
                                ROWS UNBOUNDED PRECEDING) AS upto
  FROM tokens JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens,
       (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies
FROM placed
"""

ORACLE_SQL = {
    "op3_url_filter": URL_FILTER,
    "op5_exact_topk": EXACT_TOPK,
    "op8_mixing": MIXING,
    "op10_warc": WARC,
}
