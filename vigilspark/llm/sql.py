"""DuckDB SQL for the operators that SQL can express, over the tables as they are."""

from __future__ import annotations

from vigilspark.llm import quality

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_CRC32 = ("xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: ascii(ch)::UBIGINT), lambda r, b: list_reduce(range(8), "
          "lambda q, j: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384::UBIGINT) ELSE q >> 1 END, xor(r, b)), 4294967295::UBIGINT), "
          "4294967295::UBIGINT)")


def _rule_sql(rule) -> str:
    scale, per = (100, f"* {rule.per}") if rule.per else (1, "")
    tests = []
    if rule.at_least is not None:
        tests.append(f"{scale} * {rule.measure} < {rule.at_least} {per}")
    if rule.at_most is not None:
        tests.append(f"{scale} * {rule.measure} > {rule.at_most} {per}")
    return "(" + " OR ".join(tests) + ")"


def quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({f for w in quality.STOP_WORDS for f in (w, w.capitalize(), w.upper())}))
    span = quality.WINDOW_WORDS
    base, others = [_rule_sql(r) for r in quality.BASE_RULES], [_rule_sql(r) for r in quality.RULES]
    named = ", ".join(f"CASE WHEN {_rule_sql(r)} THEN '{r.name}' END" for r in (*quality.BASE_RULES, *quality.RULES))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, grams) AS times
  FROM (SELECT r, i, array_to_string(w[i:i + {span - 1}], ' ') AS grams
        FROM (SELECT r, w, unnest(range(1, len(w) - {span - 2})) AS i FROM d))),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, range({span}) AS s(k) WHERE times > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•‣]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))::BIGINT AS n_cut_lines
  FROM d LEFT JOIN covered c USING (r))
SELECT *, {" OR ".join(base)} AS base_failed, NOT ({" OR ".join(base + others)}) AS kept,
       array_to_string(list_filter([{named}], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM m"""


TERM_SCAN = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
wt AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""


def conversation_trie() -> str:
    h = f"({_CRC32.format('conv_id::VARCHAR')} % 6)::BIGINT"
    return f"""
WITH own AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS turn, length(text)::BIGINT AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
listed AS (SELECT conv_id, list(turn ORDER BY i) AS turns, list(chars ORDER BY i) AS chars FROM own GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns, list_concat(coalesce(b.chars, [])[1:h], c.chars[h + 1:]) AS chars
  FROM (SELECT *, {h} AS h FROM listed) c LEFT JOIN listed b ON b.conv_id = c.conv_id - c.conv_id % 100),
paths AS (
  SELECT conv_id, d, array_to_string(turns[1:d], ',') AS node, array_to_string(turns[1:d - 1], ',') AS parent, d = len(turns) AS ends,
         CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars, turns
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, any_value(CASE WHEN d > 0 THEN parent END) AS parent,
         any_value(turns[1:d]) AS turns, string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ended
  FROM paths GROUP BY node, d),
children AS (SELECT parent, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
flat AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.parent = n.node AND c.d = n.d),
under AS (
  SELECT array_to_string(turns[1:a], ',') AS node, a AS d, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM flat) GROUP BY ALL)
SELECT f.conv_id::BIGINT AS conv_id, f.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
       f.n_children::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ended, '')) AS ends_sha256
FROM flat f JOIN under u ON u.node = f.node AND u.d = f.d LEFT JOIN nodes p ON p.node = f.parent AND p.d = f.d - 1"""


EMBEDDING_JOIN = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit
  FROM embeddings),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE p.fit AND q.fit AND list_cosine_similarity(p.e, q.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
direct AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id))::BIGINT AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN direct d ON d.a = vec_id LEFT JOIN least_of m ON m.a = vec_id"""


URL_FILTER = r"""
WITH RECURSIVE rules(name, verdict, host, path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
cut AS (
  SELECT row_number() OVER () AS r, page_id, html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
own AS (
  SELECT r, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT o.r, arg_max(u.name, length(u.name)) AS rule, arg_max(u.verdict, length(u.name)) AS verdict
  FROM own o JOIN rules u ON (o.host = u.host OR ends_with(o.host, '.' || u.host)) AND starts_with(o.path, u.path) GROUP BY o.r),
judged AS (SELECT o.*, f.rule, f.verdict AS ruled FROM own o LEFT JOIN fits f USING (r)),
hrefs AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"''\s<>/?#]+)', 1)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM own WHERE host <> ''),
links AS (SELECT src, dst, count(*) AS n FROM hrefs WHERE src <> dst GROUP BY ALL),
ahead AS (SELECT src, dst, 0.85 * n / sum(n) OVER (PARTITION BY src) AS share FROM links),
back AS (SELECT dst, src, 0.85 * n / sum(n) OVER (PARTITION BY dst) AS share FROM links),
seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM judged WHERE ruled IS NOT NULL GROUP BY host),
trust AS (
  SELECT host, 0.15 * good / (SELECT sum(good) FROM seeds) AS mass, 0 AS round FROM seeds WHERE good > 0
  UNION ALL SELECT a.dst, sum(t.mass * a.share), any_value(t.round) + 1 FROM trust t JOIN ahead a ON a.src = t.host WHERE t.round < 200 GROUP BY a.dst),
distrust AS (
  SELECT host, 0.15 * bad / (SELECT sum(bad) FROM seeds) AS mass, 0 AS round FROM seeds WHERE bad > 0
  UNION ALL SELECT a.src, sum(t.mass * a.share), any_value(t.round) + 1 FROM distrust t JOIN back a ON a.dst = t.host WHERE t.round < 200 GROUP BY a.src),
spread AS (
  SELECT host, sum(bad) > sum(good) AS worse
  FROM (SELECT host, mass AS good, 0 AS bad FROM trust UNION ALL SELECT host, 0, mass FROM distrust) GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN s.worse THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN spread s ON s.host = j.host"""
