"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .url_filter import LOWER, RULES, STRONGEST, UPPER, WEAKEST

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
 pair AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS met FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY ALL),
 link AS (SELECT a, b FROM pair WHERE 100 * met >= 90 * (na + nb - met)), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
 SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

OP5 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
 SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP6 = """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT *, power(n::DOUBLE, 0.5) AS weight FROM n),
 r AS (SELECT source, weight / (SELECT sum(weight) FROM w) * (SELECT sum(n) FROM w)::DOUBLE * 1.0 / n AS rate FROM w),
 t AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS j FROM r),
 p AS (SELECT source, j, exp(-rate + j * ln(rate) - list_sum(list_transform(range(1, greatest(j, 1) + 1), lambda i: ln(i::DOUBLE)))) AS p FROM t),
 c AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM p),
 d AS (SELECT *, ('0x' || substr(md5('mix:' || doc_id || ':' || source), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
 k AS (SELECT d.doc_id, count(*) AS copies FROM d JOIN c ON c.source = d.source AND c.c <= d.u GROUP BY 1)
 SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, copies + 1))::INTEGER AS copy FROM documents d JOIN k USING (doc_id)"""


def _strength(children: str, by: str) -> str:
    return f"""SELECT {by}, CASE WHEN between_ > 0 THEN least({STRONGEST}, greatest({WEAKEST}, p * (1 - p) / between_ - 1)) ELSE {STRONGEST} END AS strength FROM (
 SELECT {by}, p, CASE WHEN n1 - n2 / n1 > 0 THEN (b2 - n1 * p * p - (k - 1) * p * (1 - p)) / (n1 - n2 / n1) END AS between_ FROM (
 SELECT {by}, count(*) AS k, sum(n)::DOUBLE AS n1, sum(n::DOUBLE * n) AS n2, sum(bad)::DOUBLE / sum(n) AS p, sum(bad::DOUBLE * bad / n) AS b2 FROM {children} GROUP BY {by}))"""


def _rules() -> tuple[str, str]:
    fits = [(kind, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for kind, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for _, n, c in fits) + " END", "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, _, c in fits) + " END"


OP8 = f"""WITH own AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
 CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
 named AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM own),
 outcome AS (SELECT doc_id AS page_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN quality = 1 THEN 0 END AS bad FROM labels),
 counts AS (SELECT 0 AS root, host, domain, suffix, coalesce(sum(bad), 0) AS bad, count(bad) AS n FROM named LEFT JOIN outcome USING (page_id) GROUP BY ALL), known AS (SELECT * FROM counts WHERE n > 0),
 by_suffix AS (SELECT root, suffix, sum(bad) AS bad, sum(n) AS n FROM known GROUP BY ALL), by_domain AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM known GROUP BY ALL),
 s0 AS ({_strength('by_suffix', 'root')}), s1 AS ({_strength('by_domain', 'suffix')}), s2 AS ({_strength('known', 'domain')}),
 top AS (SELECT (sum(bad) + 1.0) / (sum(n) + 2) AS mean, coalesce((SELECT strength FROM s0), {WEAKEST}) AS strength FROM counts),
 suf AS (SELECT c.suffix, (t.mean * t.strength + sum(bad)) / (t.strength + sum(n)) AS mean, coalesce(s1.strength, {WEAKEST}) AS strength FROM counts c CROSS JOIN top t LEFT JOIN s1 ON s1.suffix = c.suffix GROUP BY c.suffix, t.mean, t.strength, s1.strength),
 dom AS (SELECT c.domain, (t.mean * t.strength + sum(bad)) / (t.strength + sum(n)) AS mean, coalesce(s2.strength, {WEAKEST}) AS strength FROM counts c JOIN suf t ON t.suffix = c.suffix LEFT JOIN s2 ON s2.domain = c.domain GROUP BY c.domain, t.mean, t.strength, s2.strength),
 post AS (SELECT c.host, t.mean * t.strength + sum(bad) AS a, (1 - t.mean) * t.strength + sum(n) - sum(bad) AS b FROM counts c JOIN dom t ON t.domain = c.domain GROUP BY c.host, t.mean, t.strength),
 low AS (SELECT host, a / (a + b) - 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM post)
 SELECT page_id, host, path, {_rules()[0]} AS rule, coalesce({_rules()[1]}, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM own JOIN low USING (host)"""
