"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from fumarole.llm import chat, quality_rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_rules() -> str:
    parts, joins, columns, verdict = [], [], [], ["NOT base_failed"]
    for n, share in quality_rules.NGRAM_SHARES.items():
        parts.append(f"""
g{n} AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS gram
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM t)),
d{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS j
         FROM (SELECT doc_id, unnest(list(i)) AS i FROM g{n} GROUP BY doc_id, gram HAVING count(*) > 1)),
c{n} AS (SELECT doc_id, count(*) AS words, CAST(sum(length(ws[j])) AS BIGINT) AS chars
         FROM d{n} JOIN t USING (doc_id) GROUP BY doc_id)""")
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        columns.append(f"coalesce(c{n}.chars, 0) AS dup_{n}gram_chars")
        verdict.append(f"dup_{n}gram_chars <= {share}::DOUBLE * greatest(word_chars, 1)")
    verdict.append(f"n_dup_lines <= {quality_rules.LINE_SHARE}::DOUBLE * greatest(n_lines, 1)")
    verdict.append(f"dup_line_chars <= {quality_rules.LINE_CHAR_SHARE}::DOUBLE * greatest(n_chars, 1)")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS copy
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (copy > 1) AS n_dup_lines,
          CAST(coalesce(sum(length(line)) FILTER (copy > 1), 0) AS BIGINT) AS dup_line_chars
          FROM l GROUP BY doc_id),{",".join(parts)},
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
      length(text) AS n_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(dup_line_chars, 0) AS dup_line_chars,
      coalesce(c5.words, 0) AS n_repeat_words, {", ".join(columns)}
      FROM t LEFT JOIN lines USING (doc_id) {" ".join(joins)}),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS}
      OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT * EXCLUDE (n_chars), {" AND ".join(verdict)} AS kept FROM b
"""


def _substrings(size: int = 35) -> str:
    return f"""
WITH t AS (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {size - 1}], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM t)),
d AS (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS j
      FROM (SELECT unnest(list({{'doc_id': doc_id, 'i': i}}), recursive := true)
            FROM g GROUP BY gram HAVING count(*) > 1)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM t),
k AS (SELECT doc_id, count(*) AS n_left, string_agg(word, ' ' ORDER BY j) AS kept
      FROM w ANTI JOIN d USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n_left, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""


def _chat() -> str:
    def hidden(text: str) -> str:
        marks = " + ".join(
            f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL
        )
        return f"length({text}) + length({text}) - length(replace({text}, '\\', '')) + {marks}"

    room = f"greatest({chat.BUDGET - chat.HISTORY} - sys_tok, 2)"
    return f"""
WITH conv AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS place,
      (length(x) + {chat.CHARS_PER_TOKEN - 1}) // {chat.CHARS_PER_TOKEN} + {chat.TURN_TOKENS} AS tok,
      {len(chat.TURN) + 1 + len(chat.END)} + {hidden("r")} + length(r) - length(replace(r, chr(10), ''))
      + {hidden("x")} AS size FROM conv),
s AS (SELECT *, place = 1 AND r = 'system' AS sys FROM p),
q AS (SELECT *, CASE WHEN sys THEN 0 ELSE tok END AS cost FROM s),
b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      max(cost) OVER (PARTITION BY conv_id) AS longest,
      max(CASE WHEN sys THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tok,
      max(CASE WHEN sys THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_size FROM q),
e AS (SELECT *, {room} AS room, CASE WHEN sys THEN 0 ELSE before // greatest({room} - longest, {room} // 2) END AS cell FROM b),
o AS (SELECT *, min(before) OVER (PARTITION BY conv_id, cell) AS opened FROM e),
k AS (SELECT *, 2 * cell + CASE WHEN NOT sys AND before > opened AND before - opened + tok > room
                                THEN 1 ELSE 0 END AS span FROM o),
spans AS (SELECT conv_id, span, min(before) AS since, max(sys_size) AS sys_size,
                 least({chat.HISTORY}, {chat.BUDGET} - max(sys_tok) - sum(tok)) AS allowed
          FROM k WHERE NOT sys GROUP BY conv_id, span),
later AS (SELECT * FROM spans WHERE span > 0),
again AS (SELECT conv_id, sum(size) AS size FROM (
    SELECT conv_id, sys_size AS size FROM later
    UNION ALL SELECT k.conv_id, k.size FROM k JOIN later ON k.conv_id = later.conv_id AND NOT k.sys
      AND k.before < later.since AND k.before >= later.since - later.allowed) GROUP BY conv_id),
w AS (SELECT conv_id, count(DISTINCT span) AS n_windows, count(*) AS n_turns, sum(size) AS size,
      sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY place)) AS turns_sha256,
      coalesce(string_agg(CASE WHEN r = 'assistant' THEN x ELSE '' END, '' ORDER BY place), '') AS loss
      FROM k GROUP BY conv_id)
SELECT w.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, n_windows,
       CAST(w.size + coalesce(again.size, 0) AS BIGINT) AS formatted_chars
FROM w LEFT JOIN again USING (conv_id)
"""


FILTER_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least_id AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
        max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
        WHEN 'A' THEN len(ws) < 50
        WHEN 'B' THEN 100 * len(list_distinct(ws)) < 65 * len(ws)
        WHEN 'C' THEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text)
        WHEN 'D' THEN regexp_matches(t.text, '[#$%&*|]')
        ELSE least IS NOT NULL AND (t.doc_id IS NULL OR least < t.doc_id) END) AS fails
      FROM t JOIN least_id USING (text) LEFT JOIN lab ON t.doc_id = lab.doc_id),
c AS (SELECT part, list_sort(fails) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before
      FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
      sum(CASE WHEN NOT list_contains(fails, own) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN list_contains(fails, own) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN list_contains(fails, own) AND list_has_any(fails, before) THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN fails = [own] THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN list_contains(fails, own) AND NOT list_has_any(fails, before) THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN list_contains(fails, own) AND NOT list_has_any(fails, before) THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def _centroids(count: int = 16, rounds: int = 3) -> str:
    def nearest(n: int) -> str:
        return f"""
a{n} AS (SELECT vec_id, row, v, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT kept.*, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
        FROM kept, c{n}) GROUP BY vec_id, row, v)"""

    def moved(n: int) -> str:
        return f"""
m{n} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY cluster, i) GROUP BY cluster),
c{n + 1} AS (SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"""

    steps = ",".join(nearest(n) + "," + moved(n) for n in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster, v AS c FROM kept
       ORDER BY cluster LIMIT {count}),{steps},{nearest(rounds)}
SELECT vec_id, CAST(a{rounds}.cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.cluster = c{rounds}.cluster
"""


URL_LISTS = r"""
WITH u AS (SELECT page_id, url,
    regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '\.$', '') AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    1704067200 + page_id * 7919 % 366 * 86400 AS fetched_epoch FROM pages),
h AS (SELECT page_id, string_split(host, '.') AS labels FROM u),
f AS (SELECT array_to_string(labels[greatest(len(labels) - 2, 1):], '.') AS domain, min(page_id) AS n
      FROM h GROUP BY 1),
f2 AS (SELECT * FROM f WHERE regexp_matches(domain, 'ads|spam|casino|pills|bets|adult') OR n % 10 = 0),
i AS (SELECT 'block' AS action, domain AS rule, domain AS host, '' AS section,
        n * 31 % 120 AS since, n * 31 % 120 + 60 AS until FROM f2
      UNION ALL SELECT 'block', domain, domain, '', n * 31 % 120 + 150, 99999 FROM f2
      UNION ALL SELECT 'allow', domain || '/en', domain, '/en', n * 17 % 90, n * 17 % 90 + 200 FROM f2),
m AS (SELECT u.page_id, i.action, i.rule, row_number() OVER (PARTITION BY u.page_id
        ORDER BY section <> '' DESC, length(rule) DESC, action, rule DESC) AS best,
      count(*) OVER (PARTITION BY u.page_id) AS n_active
      FROM u JOIN i ON (u.fetched_epoch - 1704067200) // 86400 >= since
        AND (u.fetched_epoch - 1704067200) // 86400 < until
        AND ((section = '' AND (u.host = i.host OR ends_with(u.host, '.' || i.host)))
          OR (section <> '' AND u.host = i.host AND starts_with(u.path || '/', section || '/'))))
SELECT u.page_id, u.url, CAST(u.fetched_epoch AS BIGINT) AS fetched_epoch,
       coalesce(n_active, 0) AS n_active, rule, action, coalesce(action <> 'block', true) AS kept
FROM u LEFT JOIN (SELECT * FROM m WHERE best = 1) USING (page_id)
"""

SQL = {
    "op1_chat_windows": _chat(),
    "op2_quality_rules": _quality_rules(),
    "op3_url_lists": URL_LISTS,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_centroids": _centroids(),
    "op5_substrings": _substrings(),
}
