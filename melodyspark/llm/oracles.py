"""DuckDB SQL for the queries that SQL can express."""

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH t AS (SELECT doc_id, sha256({_LOW.format('text')}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""

_WORD5 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '{_WORD5}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format('text')}, '{_WORD5}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (win, n)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_SPACED = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS sh
      FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(to_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::BIGINT AS n_tokens,
                  md5('mix:' || doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY source),
v AS (SELECT list(tokens::DOUBLE) AS ts, sum(tokens)::DOUBLE AS t, count(*) AS n FROM s WHERE tokens > 0),
h AS (SELECT 0::BIGINT AS lo, 1048577::BIGINT AS hi
      UNION ALL
      SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
      FROM (SELECT lo, hi, mid, ln(z) - list_sum(list_transform(ts, lambda x: exp(mid / 1048576.0 * ln(x / t)) * (mid / 1048576.0 * ln(x / t)))) / z >= 0.95 * ln(n) AS ok
            FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, ts, t, n, list_sum(list_transform(ts, lambda x: exp(((lo + hi) // 2) / 1048576.0 * ln(x / t)))) AS z FROM h, v) WHERE hi - lo > 1)),
r AS (SELECT -1::BIGINT AS lo, 1048577::BIGINT AS hi
      UNION ALL
      SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
      FROM (SELECT lo, hi, mid, list_max(list_transform(ts, lambda x: exp(mid / 1048576.0 * ln(x / t)) / x)) * t / z > 4.0 AS ok
            FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, ts, t, list_sum(list_transform(ts, lambda x: exp(((lo + hi) // 2) / 1048576.0 * ln(x / t)))) AS z FROM r, v) WHERE hi - lo > 1)),
tau AS (SELECT CASE WHEN (SELECT n FROM v) <= 1 THEN 1.0 ELSE greatest((SELECT max(lo) FROM h), least(1048576, (SELECT max(lo) FROM r) + 1)) / 1048576.0 END AS a),
x AS (SELECT source, tokens, docs, CASE WHEN tokens > 0 THEN exp(a * ln(tokens / t)) ELSE 0.0 END AS x, t FROM s, v, tau),
g AS (SELECT source, tokens, greatest(1, ceil(docs / 4096.0))::BIGINT AS blocks, floor(x / (SELECT sum(x) FROM x) * t + 1e-6)::BIGINT AS given FROM x),
p AS (SELECT d.*, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS full_, CASE WHEN tokens > 0 THEN given % tokens ELSE -1 END AS rest,
             (('0x' || substr(key, 1, 8))::BIGINT * blocks) >> 32 AS block FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, n_tokens, block::BIGINT AS block,
       (full_ + CASE WHEN rest < 0 THEN 0 WHEN sum(n_tokens) OVER (PARTITION BY source ORDER BY key, n_tokens, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p
"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, p FROM win JOIN rep USING (h), unnest(range(i, i + 35)) AS u(p)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN cov ON words.doc_id = cov.doc_id AND words.p = cov.p GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id) c USING (doc_id)
"""

_CANON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '\?&+', '?', 'g'), '[?&]+$', ''), '^[A-Za-z]+://', '')"""

OP9 = rf"""
WITH u AS (SELECT page_id AS p, {_CANON} AS u, md5(coalesce(html, '')) AS tag, sha256(coalesce(html, '')) AS sha FROM pages),
c AS (SELECT p, tag, sha, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^(www|m)\.', '') || regexp_replace(substr(u, length(regexp_extract(u, '^[^/?]*')) + 1), '(/|\.html)$', '') AS canonical FROM u),
v AS (SELECT 2 * p + 1 AS record_id, canonical, p + 1 + p % 97 AS t, CASE WHEN p % 5 = 0 THEN NULL WHEN p % 7 = 0 THEN 'changed' ELSE tag END AS etag,
             CASE WHEN p % 11 = 0 THEN 10 * p + 1 ELSE 10 * p END AS m FROM c),
j AS (SELECT v.*, (SELECT max(r.p) FROM c r WHERE r.canonical = v.canonical AND r.p < v.t) AS rp FROM v),
s AS (SELECT j.*, r.tag, r.sha, CASE WHEN rp IS NULL THEN 'no-response' WHEN coalesce(etag = r.tag, m = 10 * rp) THEN 'resolved' ELSE 'validator-mismatch' END AS status
      FROM j LEFT JOIN c r ON r.p = j.rp)
SELECT record_id, canonical, 2 * rp AS response_id, status, CASE WHEN status = 'resolved' THEN sha END AS payload_sha256,
       CASE WHEN status = 'resolved' THEN 'Content-Type: text/html' || chr(10) || 'Date: ' || t || chr(10) || 'ETag: ' || tag || chr(10) || 'Expires: ' || (t + 60) || chr(10) || 'Server: origin' END AS headers
FROM s
"""

OP12 = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = f"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all({_LOW.format('text')}, '{_TERM}')) AS term FROM documents),
bt AS (SELECT item_id, unnest(regexp_extract_all({_LOW.format('text')}, '{_TERM}')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
q AS (SELECT item_id, term, count(*) AS times FROM bt GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op4_source_mixing": OP4,
    "op5_benchmark_decontamination": OP5,
    "op8_exact_dedup": OP8,
    "op9_warc_revisits": OP9,
    "op10_substring_dedup": OP10,
    "op12_hard_negatives": OP12,
    "op13_ranked_search": OP13,
}
