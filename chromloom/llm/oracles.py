"""DuckDB SQL for the text operators' queries."""

from __future__ import annotations

from chromloom.llm import queries as q


def _op2() -> str:
    weights = " ".join(f"WHEN '{s}' THEN {w}" for s, w in q.SOURCE_WEIGHTS.items())
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, greatest(length(coalesce(text, '')), 1)::BIGINT AS size,
         md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
w AS (SELECT source, CASE source {weights} ELSE 1 END::BIGINT AS a FROM (SELECT DISTINCT source FROM d)),
s AS (SELECT list(source ORDER BY source) AS names, list(a ORDER BY source) AS aa, sum(a)::BIGINT AS q, count(*)::BIGINT AS n FROM w),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(aa, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS j FROM s
  UNION ALL
  SELECT t, list_transform(done, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END), pick, done[pick]
  FROM (SELECT e.t + 1 AS t, done, q,
          list_min(list_transform(list_filter(range(1, n + 1), lambda i: done[i] < aa[i] AND (done[i] * q) // aa[i] <= e.t + 1),
                   lambda i: (((done[i] + 1) * q + aa[i] - 1) // aa[i]) * 1000000 + i)) % 1000000 AS pick
        FROM edf e, s WHERE e.t + 1 < q)),
sched AS (SELECT s.names[pick] AS source, j, t FROM edf, s WHERE t >= 0),
p AS (SELECT d.doc_id, d.source, w.a, s.q,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char
      FROM d JOIN w USING (source), s),
b AS (SELECT *, start_char // {q.BLOCK_CHARS} AS block FROM p)
SELECT b.doc_id, b.source, b.a AS weight, start_char, block, (block * q) // a AS release, ((block + 1) * q + a - 1) // a AS deadline,
       (block // a) * q + sched.t AS slot
FROM b JOIN sched ON sched.source = b.source AND sched.j = b.block % b.a
"""


def _op4() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in q.URL_RULES)
    rounds = []
    for i in range(q.URL_ROUNDS):
        rounds.append(
            f"r{i + 1} AS MATERIALIZED (SELECT b.host, t0 + {q.URL_DAMPING} * coalesce(gt, 0) AS trust, d0 + {q.URL_DAMPING} * coalesce(gd, 0) AS distrust, "
            f"b0 + {q.URL_DAMPING} * coalesce(gat, 0) AS all_trust, b0 + {q.URL_DAMPING} * coalesce(gad, 0) AS all_distrust, own + {q.URL_DAMPING} * coalesce(gat, 0) AS tw, own + {q.URL_DAMPING} * coalesce(gad, 0) AS dw "
            f"FROM r0 b LEFT JOIN (SELECT dst AS host, sum(n / o * trust) AS gt, sum(n / o * all_trust) AS gat FROM e JOIN r{i} ON r{i}.host = src GROUP BY 1) x ON x.host = b.host "
            f"LEFT JOIN (SELECT src AS host, sum(n / i * distrust) AS gd, sum(n / i * all_distrust) AS gad FROM e JOIN r{i} ON r{i}.host = dst GROUP BY 1) y ON y.host = b.host)"
        )
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS ruled
         FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
j AS (SELECT p.*, rule, ruled FROM p LEFT JOIN best USING (page_id)),
link AS (SELECT DISTINCT page_id, host AS src, {lower.format("unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*[\"'']?\\s*(?:https?:)?//([^/?#\"''\\s<>]+)', 1))")} AS dst FROM p),
c AS (SELECT src, dst, count(*)::DOUBLE AS n FROM link WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
e AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY src) AS o, sum(n) OVER (PARTITION BY dst) AS i FROM c),
seeds AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS ts, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS ds, max(CASE WHEN ruled IS NULL THEN 0.0 ELSE 1.0 END) AS known FROM j GROUP BY 1
          UNION ALL SELECT src, 0, 0, 0 FROM c UNION ALL SELECT dst, 0, 0, 0 FROM c),
r0 AS MATERIALIZED (SELECT host, (1 - {q.URL_DAMPING})::DOUBLE * sum(ts) AS t0, (1 - {q.URL_DAMPING})::DOUBLE * sum(ds) AS d0,
       (1 - {q.URL_DAMPING})::DOUBLE AS b0, (1 - {q.URL_DAMPING})::DOUBLE * sum(known) AS own, t0 AS trust, d0 AS distrust, b0 AS all_trust, b0 AS all_distrust FROM seeds GROUP BY 1),
{", ".join(rounds)},
shares AS (SELECT host, trust, distrust, round(CASE WHEN tw > 0 THEN trust / tw ELSE 0 END, 9) AS trust_share, round(CASE WHEN dw > 0 THEN distrust / dw ELSE 0 END, 9) AS distrust_share FROM r{q.URL_ROUNDS})
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust_share >= {q.URL_THRESHOLD} AND distrust_share > trust_share THEN 'block' ELSE 'allow' END) AS verdict,
       round(trust, 9) AS trust, round(distrust, 9) AS distrust, trust_share, distrust_share
FROM j JOIN shares r ON r.host = j.host
"""


def _op1() -> str:
    gram = ", ".join(f"w[i + {j}]" for j in range(q.REPEAT_WORDS))
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, [{gram}] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.REPEAT_WORDS - 2})) AS i FROM d WHERE len(w) >= {q.REPEAT_WORDS})),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first_doc FROM g),
gone AS (SELECT doc_id, list(i) AS starts FROM m WHERE first_doc < doc_id GROUP BY 1),
cut AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + {q.REPEAT_WORDS})))) AS pos FROM gone),
k AS (SELECT d.doc_id, w, coalesce(len(pos), 0) AS n_removed,
             CASE WHEN pos IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(pos, i))), lambda i: w[i]) END AS kept
      FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
