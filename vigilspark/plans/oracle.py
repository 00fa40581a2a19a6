"""Equivalent DuckDB SQL for every catalogue query (the correctness oracle).

Tables ``events``, ``documents`` ... are views over the driver's parquet
files.  The SQL is generated from the same parameters as the Spark plans;
it is written independently (plain window functions, recursive CTEs for
the threshold folds).
"""

from __future__ import annotations

from vigilspark.config import MAX_ENTRIES, MAX_TRACKED_BOOTS, NS_PER_DAY, NS_PER_SECOND, AlertRules, Threshold
from vigilspark.plans import params as P

HOUR_NS = 3600 * NS_PER_SECOND


def _q(s) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


ENTRIES = """entries AS (
  SELECT epoch_us(ts) * 1000 AS timestamp_ns,
         event_id AS seq,
         'svc_' || CAST(user_id % 8 AS VARCHAR) AS source,
         event_type || ': ' || props AS raw,
         CAST(CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 5 ELSE 6 END AS INTEGER) AS priority,
         'boot_' || strftime(ts, '%Y-%m-%d') AS boot_id,
         epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS monotonic_us
  FROM events)"""


def _kw_values(rules: AlertRules, words=None, with_exclusions=True) -> str:
    words = rules.active_keywords if words is None else words
    rows = []
    for i, k in enumerate(words):
        excl = rules.exclusions.get(k) if with_exclusions else None
        rows.append(f"({_q(k)}, {_q(excl)}, {i})")
    return "kw(keyword, excl, ord) AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(keyword, excl, ord))"


def _hits(src="entries", name="hits", cols="e.*") -> str:
    return f"""{name} AS (
  SELECT {cols}, kw.keyword FROM {src} e JOIN kw
    ON contains(lower(e.raw), kw.keyword)
   AND NOT coalesce(contains(lower(e.raw), kw.excl), false))"""


def _tiers(rules: AlertRules) -> tuple:
    tiers = rules.tiers()
    groups = sorted({t[2] for t in tiers}, key=lambda x: (x.required, x.samples, x.window_seconds))
    gid = {th: i for i, th in enumerate(groups)}
    rows = [f"({_q(k)}, {_q(level)}, {_q(note)}, {gid[th]})" for k, level, th, note in tiers]
    sql = ("tiers(keyword, level, note, tgroup) AS (SELECT * FROM (VALUES " + ", ".join(rows)
           + ") t(keyword, level, note, tgroup))")
    return sql, gid


def _fold_ctes(src: str, th: Threshold, tag: str, part: str = "pattern_key, level") -> tuple:
    """CTEs producing ``fires_<tag>(pattern_key, level, note, timestamp_ns, seq, hit_count)``."""
    k = int(th.required)
    if th.window_seconds == 0 or k <= 1:
        return [f"""fires_{tag} AS (
  SELECT pattern_key, level, note, timestamp_ns, min(seq) AS seq, 1 AS hit_count
  FROM {src} GROUP BY pattern_key, level, note, timestamp_ns)"""], f"fires_{tag}"
    if th.samples < k:
        return [f"""fires_{tag} AS (
  SELECT pattern_key, level, note, timestamp_ns, seq, 0 AS hit_count FROM {src} WHERE false)"""], f"fires_{tag}"
    w = int(th.window_seconds) * NS_PER_SECOND
    return [
        f"""h_{tag} AS (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY timestamp_ns, seq) - 1 AS g,
         count(*) OVER (PARTITION BY {part} ORDER BY timestamp_ns) - 1 AS last_g
  FROM {src})""",
        f"""c_{tag} AS (
  SELECT * FROM (
    SELECT *, lag(timestamp_ns, {k - 1}) OVER (PARTITION BY {part} ORDER BY g) AS tb FROM h_{tag}) x
  WHERE tb IS NOT NULL AND timestamp_ns - tb <= CAST({w} AS BIGINT))""",
        f"""r_{tag}(pk, lv, part_id, g) AS (
  SELECT pattern_key, level, {_part_id(part)}, min(g) FROM c_{tag} GROUP BY pattern_key, level, {_part_id(part)}
  UNION ALL
  SELECT c.pattern_key, c.level, r.part_id, min(c.g)
  FROM r_{tag} r JOIN c_{tag} f
    ON f.pattern_key = r.pk AND f.level = r.lv AND {_part_id(part, 'f')} = r.part_id AND f.g = r.g
  JOIN c_{tag} c
    ON c.pattern_key = r.pk AND c.level = r.lv AND {_part_id(part, 'c')} = r.part_id AND c.g >= f.last_g + {k}
  GROUP BY c.pattern_key, c.level, r.part_id)""",
        f"""fires_{tag} AS (
  SELECT c.pattern_key, c.level, c.note, c.timestamp_ns, c.seq, {min(k, int(th.samples))} AS hit_count
  FROM c_{tag} c JOIN r_{tag} r
    ON c.pattern_key = r.pk AND c.level = r.lv AND {_part_id(part, 'c')} = r.part_id AND c.g = r.g)""",
    ], f"fires_{tag}"


def _part_id(part: str, alias: str | None = None) -> str:
    extra = [p.strip() for p in part.split(",") if p.strip() not in ("pattern_key", "level")]
    if not extra:
        return "'-'"
    return " || '|' || ".join(f"CAST({alias + '.' if alias else ''}{p} AS VARCHAR)" for p in extra)


def _flag_select(fires: str, extra: str = "", entries: str = "entries") -> str:
    return f"""SELECT e.timestamp_ns, e.source, e.raw, e.priority, f.level, e.timestamp_ns AS flagged_at,
       f.pattern_key, CAST(f.hit_count AS INTEGER) AS hit_count, f.note{extra}
FROM {fires} f JOIN {entries} e ON e.seq = f.seq AND e.timestamp_ns = f.timestamp_ns"""


def _pipeline_ctes(rules: AlertRules, levels=None, base=None, entries: str = "entries", prior: str | None = None) -> tuple:
    tiers_sql, gid = _tiers(rules)
    tests = []
    if levels is not None:
        tests.append("t.level IN (" + ", ".join(_q(x) for x in levels) + ")")
    if prior is not None:
        tests.append(f"""NOT EXISTS (SELECT 1 FROM {prior} p
      WHERE p.timestamp_ns = h.timestamp_ns AND p.pattern_key = h.source || ':' || h.keyword)""")
    where = "WHERE " + " AND ".join(tests) if tests else ""
    base = [ENTRIES] if base is None else list(base)
    ctes = base + [_kw_values(rules), _hits(src=entries, cols="e.timestamp_ns, e.seq, e.source"), tiers_sql,
            f"""thits AS (
  SELECT h.timestamp_ns, h.seq, h.source || ':' || h.keyword AS pattern_key, t.level, t.note, t.tgroup
  FROM hits h JOIN tiers t ON h.keyword = t.keyword {where})"""]
    fire_names = []
    for th, i in gid.items():
        ctes.append(f"tg{i} AS (SELECT * FROM thits WHERE tgroup = {i})")
        c, name = _fold_ctes(f"tg{i}", th, f"g{i}")
        ctes += c
        fire_names.append(name)
    union = " UNION ALL ".join(f"SELECT pattern_key, level, note, timestamp_ns, seq, hit_count FROM {n}"
                               for n in fire_names)
    ctes.append(f"fires AS ({union})")
    ctes.append(f"flags AS ({_flag_select('fires', entries=entries)})")
    return ctes


def _with(ctes, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def pipeline_sql(rules: AlertRules = P.RULES, levels=None, body: str = "SELECT * FROM flags") -> str:
    return _with(_pipeline_ctes(rules, levels), body)


# --- individual queries -------------------------------------------------------

def sql_log_entries():
    return _with([ENTRIES], "SELECT * FROM entries")


def _journal_ctes():
    return [ENTRIES, """lines AS (
  SELECT e.seq,
         CASE WHEN ev.props = '{"k": 0}' THEN ''
              WHEN ev.props = '{"k": 1}' THEN substr(js, 1, 20)
              ELSE js END AS value
  FROM entries e JOIN (
    SELECT event_id, props,
      CAST(json_object(
        '__REALTIME_TIMESTAMP', CASE WHEN props = '{"k": 2}' THEN 'x' || CAST(epoch_us(ts) AS VARCHAR) ELSE CAST(epoch_us(ts) AS VARCHAR) END,
        '_SYSTEMD_UNIT', CASE WHEN props = '{"k": 3}' THEN NULL ELSE 'svc_' || CAST(user_id % 8 AS VARCHAR) || '.service' END,
        'SYSLOG_IDENTIFIER', 'svc_' || CAST(user_id % 8 AS VARCHAR),
        'MESSAGE', CASE WHEN props = '{"k": 4}' THEN NULL ELSE event_type || ': ' || props END,
        'PRIORITY', CASE WHEN props = '{"k": 5}' THEN 'x' ELSE CAST(CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 5 ELSE 6 END AS VARCHAR) END,
        '_BOOT_ID', 'boot_' || strftime(ts, '%Y-%m-%d'),
        '__MONOTONIC_TIMESTAMP', CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS VARCHAR)
      ) AS VARCHAR) AS js
    FROM events) ev ON ev.event_id = e.seq)""",
            """parsed AS (
  SELECT seq, value,
         CASE WHEN trim(value) = '' THEN 'blank'
              WHEN NOT json_valid(value) THEN 'malformed'
              WHEN TRY_CAST(value->>'__REALTIME_TIMESTAMP' AS BIGINT) IS NULL THEN 'bad_timestamp'
         END AS reject_reason
  FROM lines)"""]


def sql_journal_parse():
    body = """SELECT seq,
       TRY_CAST(value->>'__REALTIME_TIMESTAMP' AS BIGINT) * 1000 AS timestamp_ns,
       'journalctl' AS source,
       coalesce(value->>'_SYSTEMD_UNIT', value->>'SYSLOG_IDENTIFIER', 'unknown') || ': ' || coalesce(value->>'MESSAGE', '') AS raw,
       TRY_CAST(value->>'PRIORITY' AS INTEGER) AS priority,
       coalesce(value->>'_SYSTEMD_UNIT', value->>'SYSLOG_IDENTIFIER', 'unknown') AS unit,
       value->>'_BOOT_ID' AS boot_id,
       value->>'__MONOTONIC_TIMESTAMP' AS monotonic_us
FROM parsed WHERE reject_reason IS NULL"""
    return _with(_journal_ctes(), body)


def sql_journal_alerts():
    """The alert pipeline over the parsed journal export: every row has
    source 'journalctl', so each keyword is one (hot) pattern key."""
    jentries = """jentries AS (
  SELECT seq, TRY_CAST(value->>'__REALTIME_TIMESTAMP' AS BIGINT) * 1000 AS timestamp_ns,
         'journalctl' AS source,
         coalesce(value->>'_SYSTEMD_UNIT', value->>'SYSLOG_IDENTIFIER', 'unknown') || ': ' || coalesce(value->>'MESSAGE', '') AS raw,
         TRY_CAST(value->>'PRIORITY' AS INTEGER) AS priority
  FROM parsed WHERE reject_reason IS NULL)"""
    return _with(_pipeline_ctes(P.RULES, base=_journal_ctes() + [jentries], entries="jentries"),
                 "SELECT * FROM flags")


def sql_reject_split():
    return _with(_journal_ctes(),
                 "SELECT coalesce(reject_reason, 'loaded') AS outcome, count(*) AS n FROM parsed GROUP BY 1")


def sql_keyword_hits():
    return _with([ENTRIES, _kw_values(P.RULES), _hits(cols="e.seq, e.timestamp_ns, e.source")],
                 "SELECT * FROM hits")


def sql_keyword_stats():
    return _with([ENTRIES, _kw_values(P.RULES), _hits()],
                 "SELECT source, keyword, count(*) AS hits, max(timestamp_ns) AS last_seen_ns FROM hits GROUP BY 1, 2")


def sql_keyword_first_seen():
    return _with([ENTRIES, _kw_values(P.RULES), _hits()],
                 "SELECT CAST(coalesce(min(timestamp_ns), 0) AS BIGINT) AS first_seen_ns FROM hits")


def sql_source_list():
    return _with([ENTRIES, _kw_values(P.RULES), _hits()],
                 "SELECT DISTINCT source FROM (SELECT source FROM entries UNION ALL SELECT source FROM hits) s")


def sql_line_keyword_hits():
    rules = AlertRules(watched=P.DOC_KEYWORDS, critical=[])
    return _with([
        "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM documents)",
        _kw_values(rules), _hits(src="lines", cols="e.doc_id, e.source")],
        "SELECT source, keyword, count(*) AS line_hits, count(DISTINCT doc_id) AS doc_hits FROM hits GROUP BY 1, 2")


HOURLY = """hourly AS (
  SELECT source, hour_ns,
         CAST(isodow(make_timestamp(hour_ns // 1000)) - 1 AS VARCHAR) || '_' ||
           lpad(CAST(hour(make_timestamp(hour_ns // 1000)) AS VARCHAR), 2, '0') AS slot_key,
         n
  FROM (SELECT source, timestamp_ns - (timestamp_ns % """ + str(HOUR_NS) + """) AS hour_ns, count(*) AS n
        FROM entries GROUP BY 1, 2) x)"""


def sql_hourly_counts():
    return _with([ENTRIES, HOURLY], "SELECT source, hour_ns, n, slot_key FROM hourly")


def _baseline_sel(where="") -> str:
    return f"""SELECT source, slot_key, count(*) AS count, avg(n) AS mean, var_pop(n) * count(*) AS m2
FROM hourly {where} GROUP BY 1, 2"""


def sql_slot_baseline():
    return _with([ENTRIES, HOURLY, f"b AS ({_baseline_sel()})"],
                 """SELECT source, slot_key, count, round(mean, 6) AS mean, round(m2, 6) AS m2,
       round(CASE WHEN count < 2 THEN 0.0 ELSE sqrt(m2 / (count - 1)) END, 6) AS stddev FROM b""")


def sql_baseline_merge():
    return _with([ENTRIES, HOURLY, f"b AS ({_baseline_sel()})"],
                 "SELECT source, slot_key, count, round(mean, 6) AS mean, round(m2, 6) AS m2 FROM b")


def sql_anomaly_online():
    ms, sens = P.ANOMALY_MIN_SAMPLES, P.ANOMALY_SENSITIVITY
    return _with([ENTRIES, HOURLY, """o AS (
  SELECT *,
    count(*) OVER w AS prior_samples,
    avg(n) OVER w AS prior_mean,
    stddev_samp(n) OVER w AS sd
  FROM hourly
  WINDOW w AS (PARTITION BY source, slot_key ORDER BY hour_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""],
        f"""SELECT source, hour_ns, slot_key, n, prior_samples, round(prior_mean, 6) AS prior_mean,
       round(CASE WHEN prior_samples < 2 THEN 0.0 ELSE coalesce(sd, 0.0) END, 6) AS prior_stddev,
       coalesce(CASE WHEN prior_samples < {ms} THEN false
                     ELSE n > prior_mean + {sens} * (CASE WHEN prior_samples < 2 THEN 0.0 ELSE coalesce(sd, 0.0) END) END,
                false) AS anomalous
FROM o""")


def _confidence_sql(entries_where: str, as_of: int) -> str:
    return f"""conf AS (
  SELECT seed_days, direct_days,
         least(seed_days / 14.0, 1.0) * 0.4 + least(direct_days / 14.0, 1.0) * 0.6 AS confidence
  FROM (SELECT coalesce(({as_of} - min(timestamp_ns)) / {float(NS_PER_DAY)}, 0.0) AS seed_days FROM entries {entries_where}) s,
       (SELECT coalesce(sum(end_ns - start_ns) / {float(NS_PER_DAY)}, 0.0) AS direct_days
        FROM (SELECT boot_id, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns
              FROM entries {entries_where} GROUP BY boot_id) d) o)"""


def sql_anomaly_scored():
    ms, sens = P.ANOMALY_MIN_SAMPLES, P.ANOMALY_SENSITIVITY
    te = P.TRAIN_END_NS
    return _with([ENTRIES, HOURLY, f"b AS ({_baseline_sel(f'WHERE hour_ns < {te}')})",
                  _confidence_sql(f"WHERE timestamp_ns < {te}", te)],
                 f"""SELECT h.source, h.hour_ns, h.slot_key, h.n, coalesce(b.count, 0) AS samples,
       round(b.mean, 6) AS mean,
       round(CASE WHEN b.count < 2 THEN 0.0 ELSE sqrt(b.m2 / (b.count - 1)) END, 6) AS stddev,
       coalesce(CASE WHEN b.count < {ms} THEN false
                     ELSE h.n > b.mean + {sens} * (CASE WHEN b.count < 2 THEN 0.0 ELSE sqrt(b.m2 / (b.count - 1)) END) END, false)
         AND coalesce((SELECT confidence >= 0.1 FROM conf), false) AS anomalous
FROM hourly h LEFT JOIN b ON h.source = b.source AND h.slot_key = b.slot_key
WHERE h.hour_ns >= {te}""")


def sql_confidence_report():
    return _with([ENTRIES, _confidence_sql("", P.AS_OF_NS)],
                 """SELECT round(seed_days, 6) AS seed_days, round(direct_days, 6) AS direct_days,
       round(confidence, 6) AS confidence, CAST(floor(confidence * 100) AS INTEGER) AS confidence_pct,
       confidence >= 0.1 AS monitoring_active FROM conf""")


def sql_status_report():
    cutoff = P.AS_OF_NS - P.RETENTION_HOURS * HOUR_NS
    ctes = _pipeline_ctes(P.RULES) + [_confidence_sql("", P.AS_OF_NS)]
    return _with(ctes, f"""SELECT (SELECT least(count(*), {MAX_ENTRIES}) FROM entries WHERE timestamp_ns >= {cutoff}) AS buffer_rows,
       (SELECT CAST(floor(confidence * 100) AS INTEGER) FROM conf) AS confidence_pct,
       (SELECT confidence >= 0.1 FROM conf) AS monitoring_active,
       (SELECT count(*) FROM flags) AS flagged_count""")


def sql_triage_alerts():
    return pipeline_sql(levels=["TRIAGE"], body="""SELECT *, format('ALERT ({}): {} — {}', level, source, substr(raw, 1, 80)) AS alert_line FROM flags""")


def _standard_keywords():
    r = P.RULES
    return [k for k in r.active_keywords if k not in r.critical_keywords and k not in r.noisy]


def sql_pattern_watch_alerts():
    ks = ", ".join(_q(k) for k in _standard_keywords())
    return pipeline_sql(levels=["PATTERN_WATCH"],
                        body=f"SELECT * FROM flags WHERE regexp_extract(pattern_key, '[^:]*$') IN ({ks})")


def sql_noisy_alerts():
    ks = ", ".join(_q(k) for k in P.RULES.noisy)
    return pipeline_sql(levels=["PATTERN_WATCH"],
                        body=f"SELECT * FROM flags WHERE regexp_extract(pattern_key, '[^:]*$') IN ({ks})")


def sql_correlation_alerts():
    g = P.RULES.correlation[0]
    srcs = ", ".join(_q(s) for s in g.sources)
    note = f"Keyword '{g.keyword}' correlated across {', '.join(g.sources)}"
    ctes = [ENTRIES, _kw_values(P.RULES), _hits(cols="e.timestamp_ns, e.seq, e.source"),
            f"""ch AS (SELECT timestamp_ns, seq, {_q(g.name)} AS pattern_key, 'CORRELATION' AS level, {_q(note)} AS note
  FROM hits WHERE keyword = {_q(g.keyword)} AND source IN ({srcs}))"""]
    c, name = _fold_ctes("ch", g.threshold, "corr")
    return _with(ctes + c, _flag_select(name))


def _span_sql(g, sources: int) -> str:
    """The fold as it is told: hit by hit, from the first hit counted since the last fire."""
    k, n, w = int(g.threshold.required), int(g.threshold.samples), int(g.threshold.window_seconds) * NS_PER_SECOND
    srcs = ", ".join(_q(s) for s in g.sources)
    note = f"Keyword '{g.keyword}' correlated across {', '.join(g.sources)}"
    ctes = [ENTRIES, _kw_values(P.RULES), _hits(cols="e.timestamp_ns, e.seq, e.source"),
            f"""ch AS (SELECT timestamp_ns, seq, source, row_number() OVER (ORDER BY timestamp_ns, seq) AS g
  FROM hits WHERE keyword = {_q(g.keyword)} AND source IN ({srcs}))""",
            f"""fold(g, since, fired, counted) AS (
  SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT), false, CAST(0 AS BIGINT)
  UNION ALL
  SELECT x.g, CASE WHEN x.n >= {k} AND x.s >= {sources} THEN x.g + 1 ELSE x.since END, x.n >= {k} AND x.s >= {sources}, x.n
  FROM (SELECT now.g, f.since, count(h.g) AS n, count(DISTINCT h.source) AS s
        FROM fold f JOIN ch now ON now.g = f.g + 1
        JOIN ch h ON h.g BETWEEN greatest(f.since, now.g - {n - 1}) AND now.g AND h.timestamp_ns >= now.timestamp_ns - {w}
        GROUP BY now.g, f.since) x)""",
            f"""fires_span AS (
  SELECT {_q(g.name)} AS pattern_key, 'CORRELATION' AS level, {_q(note)} AS note, c.timestamp_ns, c.seq, f.counted AS hit_count
  FROM fold f JOIN ch c ON c.g = f.g WHERE f.fired)"""]
    return _with(ctes, _flag_select("fires_span"))


def sql_correlation_span_alerts():
    return _span_sql(P.RULES.correlation[0], 2)


def sql_correlation_three_sources():
    return _span_sql(P.THREE_SOURCES, 3)


def sql_alert_pipeline():
    return pipeline_sql()


def sql_error_alerts_1h():
    rules = AlertRules(watched=["error"], critical=[])
    note = rules.tier_of("error")[2]
    ctes = [ENTRIES, _kw_values(rules), _hits(cols="e.timestamp_ns, e.seq, e.source"),
            f"""eh AS (SELECT timestamp_ns, seq, source || ':' || keyword AS pattern_key, 'PATTERN_WATCH' AS level,
  {_q(note)} AS note FROM hits WHERE keyword = 'error')"""]
    c, name = _fold_ctes("eh", P.EXTRA_THRESHOLD, "x")
    return _with(ctes + c, _flag_select(name))


def sql_window_hit_count():
    w = P.HIT_WINDOW_SECONDS * NS_PER_SECOND
    return _with([ENTRIES, _kw_values(P.RULES), _hits(cols="e.timestamp_ns, e.seq, e.source")],
                 f"""SELECT source || ':' || keyword AS pattern_key, timestamp_ns, seq,
       count(*) OVER (PARTITION BY source, keyword ORDER BY timestamp_ns
                      RANGE BETWEEN CAST({w} AS BIGINT) PRECEDING AND CURRENT ROW) AS hits_in_window
FROM hits WHERE keyword = 'error'""")


def sql_pattern_reset():
    rules = P.RULES
    note = rules.tier_of("error")[2]
    ctes = [ENTRIES, _kw_values(rules), _hits(cols="e.timestamp_ns, e.seq, e.source"),
            f"""eh AS (SELECT timestamp_ns, seq, source || ':' || keyword AS pattern_key, 'PATTERN_WATCH' AS level,
  {_q(note)} AS note, timestamp_ns // {NS_PER_DAY} AS day FROM hits WHERE keyword = 'error')"""]
    c, name = _fold_ctes("eh", rules.thresholds["PATTERN_WATCH"], "rs", part="pattern_key, level, day")
    return _with(ctes + c, _flag_select(name))


def sql_aggregate_rollup():
    rules = P.RULES
    a = P.AGG_ANCHOR_NS
    parts = []
    for kw, interval in rules.aggregate.items():
        i_ns = interval * NS_PER_SECOND
        parts.append(f"""SELECT {_q(kw)} AS keyword, {interval} AS interval_s,
       {a} + ((timestamp_ns - {a}) // {i_ns} + 1) * {i_ns} AS end_ns
FROM entries WHERE contains(lower(raw), {_q(kw)})""")
    return _with([ENTRIES, "ah AS (" + " UNION ALL ".join(parts) + ")"],
                 """SELECT end_ns AS timestamp_ns, 'aggregate' AS source, keyword AS raw, CAST(NULL AS INTEGER) AS priority,
       'AGGREGATE' AS level, end_ns AS flagged_at, 'aggregate:' || keyword AS pattern_key,
       CAST(count(*) AS INTEGER) AS hit_count,
       CAST(count(*) AS VARCHAR) || ' hits aggregated over the last ' || CAST(interval_s AS VARCHAR) || 's (quarantined keyword)' AS note
FROM ah GROUP BY keyword, interval_s, end_ns""")


def _boot_ctes():
    w_us = P.BOOT_WINDOW_SECONDS * 1_000_000
    return [ENTRIES, _kw_values(P.RULES),
            f"bw AS (SELECT * FROM entries WHERE boot_id IS NOT NULL AND boot_id <> '' AND monotonic_us < {w_us})",
            _hits(src="bw", cols="e.boot_id, e.timestamp_ns"),
            """bs AS (SELECT boot_id, keyword, count(*) AS hits, min(timestamp_ns) AS first_seen_ns,
         max(timestamp_ns) AS last_seen_ns FROM hits GROUP BY 1, 2)"""]


def sql_boot_window_stats():
    return _with(_boot_ctes(), "SELECT * FROM bs")


def sql_boot_retained():
    return _with(_boot_ctes() + [f"""nb AS (SELECT boot_id FROM (SELECT boot_id, min(first_seen_ns) AS f FROM bs GROUP BY 1) x
  ORDER BY f DESC, boot_id DESC LIMIT {P.BOOTS_KEPT})"""],
                 "SELECT * FROM bs WHERE boot_id IN (SELECT boot_id FROM nb)")


def sql_boot_summary():
    return _with(_boot_ctes(), """SELECT * FROM bs WHERE boot_id = (
  SELECT arg_max(boot_id, f) FROM (SELECT boot_id, min(first_seen_ns) AS f FROM bs GROUP BY 1) x)""")


def sql_rolling_window():
    cutoff = P.AS_OF_NS - P.RETENTION_HOURS * HOUR_NS
    return _with([ENTRIES], f"SELECT * FROM entries WHERE timestamp_ns >= {cutoff}")


def sql_capped_buffer():
    cutoff = P.AS_OF_NS - P.RETENTION_HOURS * HOUR_NS
    return _with([ENTRIES], f"SELECT * FROM entries WHERE timestamp_ns >= {cutoff} ORDER BY seq DESC LIMIT {P.BUFFER_CAP}")


def sql_incremental_batch():
    return _with([ENTRIES], f"""SELECT seq, timestamp_ns, source FROM entries
WHERE seq > coalesce((SELECT max(seq) FROM entries WHERE timestamp_ns < {P.INCREMENTAL_HWM_BEFORE_NS}), -1)""")


def sql_pause_filtered():
    conds = " OR ".join(f"(timestamp_ns >= {a} AND timestamp_ns < {b})" for a, b in P.PAUSES)
    return _with([ENTRIES], f"SELECT seq, timestamp_ns, source FROM entries WHERE NOT ({conds})")


def sql_flag_query():
    return pipeline_sql(body=f"SELECT * FROM flags WHERE level = 'PATTERN_WATCH' AND flagged_at >= {P.FLAG_SINCE_NS}")


def sql_flag_counts():
    return pipeline_sql(body="SELECT level, count(*) AS n FROM flags GROUP BY ROLLUP (level)")


def sql_flag_archive_split():
    cutoff = P.AS_OF_NS - P.ARCHIVE_DAYS * NS_PER_DAY
    return pipeline_sql(body=f"SELECT *, CASE WHEN flagged_at < {cutoff} THEN 'archive' ELSE 'live' END AS destination FROM flags")


def sql_flag_clear():
    return pipeline_sql(body="SELECT * FROM flags WHERE level <> 'TRIAGE'")


def sql_rule_coverage():
    from vigilspark.operators.rules import rule_keywords
    rules = P.RULES
    rows = []
    for k in rule_keywords(rules):
        level = rules.tier_of(k)[0] if k in rules.active_keywords else None
        excl = rules.exclusions.get(k) if k in rules.active_keywords else None
        rows.append(f"({_q(k)}, {_q(level)}, {_q(excl)})")
    return _with([ENTRIES, "r(keyword, level, excl) AS (SELECT * FROM (VALUES " + ", ".join(rows)
                  + ") t(keyword, level, excl))"],
                 """SELECT r.keyword, r.level,
       (SELECT count(*) FROM entries e WHERE contains(lower(e.raw), r.keyword)
          AND NOT coalesce(contains(lower(e.raw), r.excl), false)) AS matched_lines,
       r.level IS NOT NULL AS reachable
FROM r""")


def sql_flag_store_roundtrip():
    return pipeline_sql(body=f"SELECT * FROM flags WHERE level = 'PATTERN_WATCH' AND flagged_at >= {P.FLAG_SINCE_NS}")


def sql_buffer_snapshot_load():
    cutoff = P.AS_OF_NS - P.RETENTION_HOURS * HOUR_NS
    load_cutoff = P.AS_OF_NS + P.SNAPSHOT_LOAD_DELAY_NS - P.RETENTION_HOURS * HOUR_NS
    return _with([ENTRIES], f"""SELECT timestamp_ns, source, raw, priority FROM entries
WHERE timestamp_ns >= {cutoff} AND timestamp_ns >= {load_cutoff}""")


def sql_history_seed():
    """Journal rows that survive parsing, as the seed job sees them."""
    ctes = _journal_ctes() + [
        """good AS (
  SELECT TRY_CAST(value->>'__REALTIME_TIMESTAMP' AS BIGINT) * 1000 AS timestamp_ns,
         'journalctl' AS source,
         coalesce(value->>'_SYSTEMD_UNIT', value->>'SYSLOG_IDENTIFIER', 'unknown') || ': ' || coalesce(value->>'MESSAGE', '') AS raw
  FROM parsed WHERE reject_reason IS NULL)""",
        _kw_values(P.RULES),
        _hits(src="good", cols="e.timestamp_ns, e.source"),
        f"""hh AS (SELECT timestamp_ns - (timestamp_ns % {HOUR_NS}) AS hour_ns, count(*) AS n FROM good GROUP BY 1)""",
        f"""slots AS (SELECT DISTINCT CAST(isodow(make_timestamp(hour_ns // 1000)) - 1 AS VARCHAR) || '_' ||
           lpad(CAST(hour(make_timestamp(hour_ns // 1000)) AS VARCHAR), 2, '0') AS slot_key FROM hh)""",
        f"""m AS (SELECT ({P.AS_OF_NS} - min(timestamp_ns)) / {float(NS_PER_DAY)} AS seed_days FROM good)"""]
    return _with(ctes, """SELECT (SELECT CAST(coalesce(min(timestamp_ns), 0) AS BIGINT) FROM hits) AS first_seen_ns,
       round(seed_days, 6) AS seed_days, CAST(0.0 AS DOUBLE) AS direct_days,
       round(least(seed_days / 14.0, 1.0) * 0.4, 6) AS confidence,
       CAST(floor(least(seed_days / 14.0, 1.0) * 0.4 * 100) AS INTEGER) AS confidence_pct,
       least(seed_days / 14.0, 1.0) * 0.4 >= 0.1 AS monitoring_active,
       (SELECT count(*) FROM slots) AS baseline_rows,
       (SELECT count(*) FROM hh) AS hour_samples,
       (SELECT count(DISTINCT keyword) FROM hits) AS keyword_rows
FROM m""")


REPEATED = """again AS (
  SELECT * FROM entries UNION ALL
  SELECT timestamp_ns, seq + 1000000000 AS seq, source, raw, priority, boot_id, monotonic_us FROM entries WHERE seq % 5 = 0)"""


def sql_dedup_rerun():
    first = _with(_pipeline_ctes(P.RULES, base=[ENTRIES, REPEATED, f"half AS (SELECT * FROM again WHERE timestamp_ns < {P.MERGE_SPLIT_NS})"],
                                 entries="half"), "SELECT timestamp_ns, pattern_key FROM flags")
    return _with(_pipeline_ctes(P.RULES, base=[ENTRIES, REPEATED, f"prior AS ({first})"], entries="again", prior="prior"), "SELECT * FROM flags")


def sql_mixed_source_alerts():
    mixed = f"""mixed AS (
  SELECT seq, TRY_CAST(value->>'__REALTIME_TIMESTAMP' AS BIGINT) * 1000 AS timestamp_ns, 'journalctl' AS source,
         coalesce(value->>'_SYSTEMD_UNIT', value->>'SYSLOG_IDENTIFIER', 'unknown') || ': ' || coalesce(value->>'MESSAGE', '') AS raw,
         TRY_CAST(value->>'PRIORITY' AS INTEGER) AS priority
  FROM parsed WHERE reject_reason IS NULL
  UNION ALL
  SELECT doc_id * 1048576 + line_no - 1 AS seq, {P.AGG_ANCHOR_NS} + doc_id // 3 * {NS_PER_SECOND} AS timestamp_ns, source || '.log' AS source,
         line AS raw, CAST(NULL AS INTEGER) AS priority
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM documents) d)"""
    return _with(_pipeline_ctes(P.MIXED_RULES, base=_journal_ctes() + [mixed], entries="mixed"), "SELECT * FROM flags")


def sql_flag_table_counts():
    rollups = sql_aggregate_rollup()
    return pipeline_sql(body=f"""SELECT level, count(*) AS n FROM (
  SELECT level FROM flags UNION ALL SELECT level FROM ({rollups}) r) x GROUP BY ROLLUP (level)""")


def sql_archive_move():
    cutoff = P.AS_OF_NS - P.ARCHIVE_DAYS * NS_PER_DAY
    return pipeline_sql(body=f"""SELECT *, CASE WHEN flagged_at < {cutoff} THEN 'archive' ELSE 'live' END AS destination,
  (SELECT count(*) FROM flags WHERE flagged_at < {cutoff}) AS moved FROM flags""")


def sql_clear_rewrite():
    return pipeline_sql(body="""SELECT *, (SELECT count(*) FROM flags WHERE level = 'TRIAGE') AS removed
FROM flags WHERE level <> 'TRIAGE'""")


def sql_seed_in_two_parts():
    w_us = P.BOOT_WINDOW_SECONDS * 1_000_000
    ctes = _journal_ctes() + [
        """good AS (
  SELECT TRY_CAST(value->>'__REALTIME_TIMESTAMP' AS BIGINT) * 1000 AS timestamp_ns, 'journalctl' AS source,
         coalesce(value->>'_SYSTEMD_UNIT', value->>'SYSLOG_IDENTIFIER', 'unknown') || ': ' || coalesce(value->>'MESSAGE', '') AS raw,
         value->>'_BOOT_ID' AS boot_id, TRY_CAST(value->>'__MONOTONIC_TIMESTAMP' AS BIGINT) AS monotonic_us
  FROM parsed WHERE reject_reason IS NULL)""",
        _kw_values(P.RULES), _hits(src="good", cols="e.timestamp_ns, e.source, e.boot_id, e.monotonic_us"),
        f"""hh AS (SELECT timestamp_ns - (timestamp_ns % {HOUR_NS}) AS hour_ns, count(*) AS n FROM good GROUP BY 1)""",
        """slots AS (SELECT CAST(isodow(make_timestamp(hour_ns // 1000)) - 1 AS VARCHAR) || '_' ||
           lpad(CAST(hour(make_timestamp(hour_ns // 1000)) AS VARCHAR), 2, '0') AS slot_key, n FROM hh)""",
        f"""bs AS (SELECT boot_id, keyword, count(*) AS hits, min(timestamp_ns) AS f, max(timestamp_ns) AS l FROM hits
  WHERE boot_id <> '' AND monotonic_us < {w_us} GROUP BY 1, 2)""",
        f"""nb AS (SELECT boot_id FROM (SELECT boot_id, min(f) AS f FROM bs GROUP BY 1) x ORDER BY f DESC, boot_id DESC LIMIT {MAX_TRACKED_BOOTS})"""]
    return _with(ctes, f"""SELECT 'baseline' AS kind, slot_key AS a, 'journalctl' AS b, count(*) AS n, round(avg(n), 6) AS x, CAST(0 AS BIGINT) AS t FROM slots GROUP BY slot_key
UNION ALL SELECT 'keyword', source, keyword, count(*), 0.0, max(timestamp_ns) FROM hits GROUP BY source, keyword
UNION ALL SELECT 'boot', boot_id, keyword, hits, 0.0, f FROM bs WHERE boot_id IN (SELECT boot_id FROM nb)
UNION ALL SELECT 'meta', '', '', CAST(0 AS BIGINT), round(({P.AS_OF_NS} - min(timestamp_ns)) / {float(NS_PER_DAY)}, 6),
                 (SELECT min(timestamp_ns) FROM hits) FROM good""")


def sql_anomaly_two_parts():
    return sql_anomaly_online()


def sql_live_anomalies():
    ms, sens, split = P.ANOMALY_MIN_SAMPLES, P.ANOMALY_SENSITIVITY, P.MERGE_SPLIT_NS
    return _with(_journal_ctes() + [f"""hours AS (
  SELECT hour_ns, CAST(isodow(make_timestamp(hour_ns // 1000)) - 1 AS VARCHAR) || '_' ||
           lpad(CAST(hour(make_timestamp(hour_ns // 1000)) AS VARCHAR), 2, '0') AS slot_key, n
  FROM (SELECT t - (t % {HOUR_NS}) AS hour_ns, count(*) AS n
        FROM (SELECT TRY_CAST(value->>'__REALTIME_TIMESTAMP' AS BIGINT) * 1000 AS t FROM parsed WHERE reject_reason IS NULL) x GROUP BY 1) y)""",
        f"""base AS (
  SELECT slot_key, count(*) AS samples, avg(n) AS mean, coalesce(stddev_samp(n), 0.0) AS stddev FROM hours WHERE hour_ns < {split} GROUP BY 1)"""],
        f"""SELECT 'journalctl' AS source, hour_ns, h.slot_key, n, coalesce(samples, 0) AS samples, round(mean, 6) AS mean, round(stddev, 6) AS stddev,
       coalesce(samples >= {ms} AND n > mean + {sens} * stddev, false) AS anomalous
FROM hours h LEFT JOIN base b USING (slot_key) WHERE hour_ns >= {split}""")


def sql_text_log_lines():
    return """SELECT raw, count(*) AS lines, count(*) AS numbers
FROM (SELECT unnest(string_split(text, chr(10))) AS raw FROM documents) x GROUP BY raw"""


def sql_rules_table_hits():
    return """WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS keyword FROM benchmark),
rules AS (
  SELECT keyword, CASE WHEN length(keyword) > 6 THEN substr(keyword, 3, 4) WHEN length(keyword) = 4 THEN 'license' END AS exclusion
  FROM words WHERE length(keyword) > 2),
lines AS (SELECT doc_id, source, lower(unnest(string_split(text, chr(10)))) AS low FROM documents)
SELECT source, keyword, count(*) AS line_hits, count(DISTINCT doc_id) AS doc_hits
FROM lines JOIN rules ON contains(low, keyword) AND (exclusion IS NULL OR NOT contains(low, exclusion)) GROUP BY 1, 2"""


def _arrival_ctes():
    return _journal_ctes() + [f"""arrived AS (
  SELECT p.*, e.timestamp_ns >= {P.MERGE_SPLIT_NS} AS second,
         row_number() OVER (ORDER BY e.timestamp_ns >= {P.MERGE_SPLIT_NS}, p.seq) - 1 AS arrival
  FROM parsed p JOIN entries e USING (seq))""", """jentries AS (
  SELECT arrival AS seq, TRY_CAST(value->>'__REALTIME_TIMESTAMP' AS BIGINT) * 1000 AS timestamp_ns,
         'journalctl' AS source,
         coalesce(value->>'_SYSTEMD_UNIT', value->>'SYSLOG_IDENTIFIER', 'unknown') || ': ' || coalesce(value->>'MESSAGE', '') AS raw,
         TRY_CAST(value->>'PRIORITY' AS INTEGER) AS priority,
         coalesce(value->>'_SYSTEMD_UNIT', value->>'SYSLOG_IDENTIFIER', 'unknown') AS unit,
         value->>'_BOOT_ID' AS boot_id,
         value->>'__MONOTONIC_TIMESTAMP' AS monotonic_us, second
  FROM arrived WHERE reject_reason IS NULL)"""]


def sql_journal_incremental():
    return _with(_arrival_ctes(), "SELECT * EXCLUDE (second) FROM jentries WHERE second")


def sql_journal_capped():
    return _with(_arrival_ctes(), f"SELECT * EXCLUDE (second) FROM jentries ORDER BY seq DESC LIMIT {P.BUFFER_CAP}")


def sql_archive_live():
    return sql_archive_move()


def sql_live_baseline_merge():
    stretches = f"""SELECT coalesce(sum(t1 - t0), 0) AS ns FROM (
  SELECT max(timestamp_ns) - min(timestamp_ns) AS d, max(timestamp_ns) AS t1, min(timestamp_ns) AS t0 FROM good
  WHERE timestamp_ns >= {P.MERGE_SPLIT_NS} GROUP BY timestamp_ns >= {P.TRAIN_END_NS}) x"""
    days = float(NS_PER_DAY)
    return sql_seed_in_two_parts() + f"""
UNION ALL SELECT 'observed', '', '', CAST(0 AS BIGINT),
  round(0.4 * least((({P.AS_OF_NS} - (SELECT min(timestamp_ns) FROM good)) / {days}) / 14, 1.0) + 0.6 * least((s.ns / {days}) / 14, 1.0), 6),
  CAST(s.ns AS BIGINT) FROM ({stretches}) s"""


SQL = {name[4:]: fn for name, fn in list(globals().items()) if name.startswith("sql_") and callable(fn)}


def oracle_sql() -> dict:
    return {name: fn() for name, fn in SQL.items()}
