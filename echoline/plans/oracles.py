"""DuckDB SQL for the queries, each a statement over the driver's tables."""

import re

from ..bridge import CALENDAR, COLLECTED, LAUNCH, PROCESSED, SALT, STRIDE
from ..functions.text import EDGES, NEGATIVE, POSITIVE, SCRIPTS, STOP_WORDS
from .queries import FINGERPRINT

_words = lambda ws: ", ".join(f"'{w}'" for w in ws)
_days = ", ".join(f"('{i}', DATE '{d}')" for i, d in CALENDAR)
_edge = "".join(c.replace("'", "''") for c in EDGES)

RECORDS = f"""
    cal(cid, day) AS (VALUES {_days}),
    base AS (
        SELECT d.doc_id, 's' || (d.doc_id % 3) || ':' || d.doc_id AS id, 's' || (d.doc_id % 3) AS source,
               date_trunc('second', e.ts) AS created_utc, TIMESTAMP '{COLLECTED}' AS collected_at,
               substr(sha256(e.user_id || '{SALT}'), 1, 16) AS author_hash, d.text, d.lang AS language,
               CAST(floor(e.value) AS BIGINT) AS score, e.event_type AS context_id, l.quality = 1 AS voted_up
        FROM documents d JOIN events e ON e.event_id = (d.doc_id * {STRIDE}) % (SELECT count(*) FROM events)
        LEFT JOIN labels l ON l.doc_id = d.doc_id
    ),
    tagged AS (
        SELECT b.doc_id, min({{'d': abs(epoch_us(created_utc) - epoch_us(CAST(day AS TIMESTAMP))), 'day': day, 'cid': cid}}) AS best
        FROM base b JOIN cal ON abs(epoch_us(created_utc) - epoch_us(CAST(day AS TIMESTAMP))) <= 259200000000 GROUP BY 1
    ),
    records AS (SELECT base.*, coalesce(best.cid, 'general') AS event_tag FROM base LEFT JOIN tagged USING (doc_id)),
    landing AS (
        SELECT * FROM records UNION ALL BY NAME
        SELECT * REPLACE (collected_at + INTERVAL 1 HOUR AS collected_at, score + 100 AS score) FROM records WHERE doc_id % 7 = 0
    )
"""
EVENTS = RECORDS + f""",
    tokens AS (SELECT doc_id, list_transform(string_split_regex(text, '\\s+'), lambda w: lower(trim(w, '{_edge}'))) AS t FROM records),
    hits AS (
        SELECT doc_id, len(list_filter(t, lambda w: w IN ({_words(POSITIVE)}))) AS good, len(list_filter(t, lambda w: w IN ({_words(NEGATIVE)}))) AS bad
        FROM tokens
    ),
    ev AS (
        SELECT r.*, CASE WHEN trim(regexp_replace(text, '\\s', '', 'g')) = '' THEN 'neu' WHEN good > bad THEN 'pos' WHEN bad > good THEN 'neg'
                    ELSE (['pos', 'neu', 'neg'])[1 + CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) % 3] END AS sentiment_label,
               CASE WHEN good <> bad AND trim(regexp_replace(text, '\\s', '', 'g')) <> '' THEN 0.75 ELSE 0.34 END::DOUBLE AS sentiment_score,
               'stub/1' AS model_version
        FROM records r JOIN hits USING (doc_id)
    )
"""
_part = lambda i: f"(CAST('0x' || substr(md5(id), {i}, 3) AS INTEGER) + 1)"
GOLD = EVENTS + f""",
    gold AS (
        SELECT id, doc_id, language, source, (['pos', 'neu', 'neg'])[1 + CAST('0x' || substr(md5(id), 1, 2) AS INTEGER) % 3] AS gold,
               sentiment_label AS pred, {_part(4)} / ({_part(4)} + {_part(7)} + {_part(10)}) AS p_pos,
               {_part(7)} / ({_part(4)} + {_part(7)} + {_part(10)}) AS p_neu, {_part(10)} / ({_part(4)} + {_part(7)} + {_part(10)}) AS p_neg,
               CASE doc_id % 5 WHEN 0 THEN 'holdout' WHEN 1 THEN 'dev' ELSE 'train' END AS split
        FROM ev WHERE voted_up IS NOT NULL
    )
"""
COUNTS = """count(*) AS records, count(*) FILTER (sentiment_label = 'pos') AS positive,
    count(*) FILTER (sentiment_label = 'neu') AS neutral, count(*) FILTER (sentiment_label = 'neg') AS negative"""
_share = lambda x: f"round(count(*) FILTER (sentiment_label = '{x}') / count(*), 9)"
POS, NEU, NEG = (f"{_share(x)} AS {n}_share" for x, n in (("pos", "positive"), ("neu", "neutral"), ("neg", "negative")))
_net = "(count(*) FILTER (sentiment_label = 'pos') - count(*) FILTER (sentiment_label = 'neg')) / count(*)"
NET = f"round({_net}, 9) AS net_sentiment"
CONF, AUTH = "round(avg(sentiment_score), 9) AS avg_confidence", "count(DISTINCT author_hash) AS distinct_authors"
_polarity = "CASE sentiment_label WHEN 'pos' THEN 1.0 WHEN 'neu' THEN 0.0 ELSE -1.0 END"
_ts = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_date = lambda c: f"strftime({c}, '%Y-%m-%d')"
DAILY = f"daily AS (SELECT CAST(created_utc AS DATE) AS event_date, source, event_tag, {COUNTS}, {POS}, {NEG}, {NET}, {CONF}, {AUTH} FROM ev GROUP BY ALL)"
LIFT = f"""lift AS (
        SELECT p.event_tag, p.source, n AS records, d AS days, round(s / n, 9) AS net_sentiment, round(n / d, 9) AS per_day, bn AS baseline_records, bd AS baseline_days,
               round(bs / nullif(bn, 0), 9) AS baseline_net_sentiment, round(bn / nullif(bd, 0), 9) AS baseline_per_day,
               round(s / n - bs / nullif(bn, 0), 9) AS net_lift, round((n / d) / (bn / nullif(bd, 0)), 9) AS volume_multiplier
        FROM (
            SELECT p.event_tag, p.source, count(*) FILTER (hit) AS n, count(DISTINCT day) FILTER (hit) AS d, sum(lean) FILTER (hit) AS s,
                   count(*) FILTER (NOT hit) AS bn, count(DISTINCT day) FILTER (NOT hit) AS bd, coalesce(sum(lean) FILTER (NOT hit), 0) AS bs
            FROM (SELECT DISTINCT event_tag, source FROM ev WHERE event_tag <> 'general') p,
                 LATERAL (SELECT coalesce(e.event_tag = p.event_tag, false) AS hit, CAST(e.created_utc AS DATE) AS day,
                                 CASE e.sentiment_label WHEN 'pos' THEN 1 WHEN 'neg' THEN -1 ELSE 0 END AS lean FROM ev e WHERE e.source = p.source)
            GROUP BY ALL
        ) p
    )"""
_z = lambda e: f"coalesce({e}, 0)"


def _prf(x: str) -> str:
    return f"""count(*) FILTER (gold = '{x}' AND pred = '{x}') AS tp_{x}, count(*) FILTER (gold <> '{x}' AND pred = '{x}') AS fp_{x},
        count(*) FILTER (gold = '{x}' AND pred <> '{x}') AS fn_{x}"""


SUMS = "count(*) AS n, count(*) FILTER (gold = pred) AS ok, " + ", ".join(map(_prf, ("pos", "neu", "neg")))
_p = lambda x: _z(f"tp_{x} / nullif(tp_{x} + fp_{x}, 0)")
_r = lambda x: _z(f"tp_{x} / nullif(tp_{x} + fn_{x}, 0)")
_f = lambda x: _z(f"2 * tp_{x} / nullif(2 * tp_{x} + fp_{x} + fn_{x}, 0)")
_macro = lambda g: f"round(({g('pos')} + {g('neu')} + {g('neg')}) / 3, 9)"
ACC = "round(ok / n, 9) AS accuracy"

_h = lambda seed: f"md5('{seed}:' || id)"
#: Stratified pick of n rows of a relation (id, language, label): languages take turns, rest by digest.
def _pick(name: str, of: str, n: str, seed: int = 33) -> str:
    return f"""{name}_a AS (SELECT *, label || '|' || CASE WHEN lower(trim(language)) = 'en' THEN 'en' ELSE 'non-en' END AS st, {_h(seed)} AS h FROM {of}),
        {name}_b AS (SELECT *, row_number() OVER (PARTITION BY st, language ORDER BY h, id) AS lr FROM {name}_a),
        {name}_c AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY lr, language) AS turn, greatest(1, ({n}) // (SELECT count(DISTINCT st) FROM {name}_a)) AS quota FROM {name}_b),
        {name} AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY turn <= quota DESC, h, id) AS place FROM {name}_c) WHERE place <= ({n}))"""


_proportional = lambda of, label, n, seed: f"""(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rn <= round_even(size * {n} / total, 0) DESC, h, id) AS place FROM (
        SELECT *, {_h(seed)} AS h, row_number() OVER (PARTITION BY {label} ORDER BY {_h(seed)}, id) AS rn, count(*) OVER (PARTITION BY {label}) AS size, count(*) OVER () AS total FROM {of})) WHERE place <= {n})"""  # noqa: E731
REVIEW = GOLD + """,
    old AS (SELECT id, language, gold AS label, split FROM gold WHERE doc_id % 2 = 0 OR doc_id % 10 = 5),
    review AS (
        SELECT id, language, doc_id, CASE WHEN doc_id % 3 = 0 THEN (['pos', 'neu', 'neg'])[1 + doc_id % 7 % 3] END AS human, sentiment_label AS model, doc_id % 4 = 1 AS required
        FROM ev WHERE doc_id % 2 = 1 AND id NOT IN (SELECT id FROM old)
    ),
    done AS (SELECT id, language, coalesce(human, model) AS label, CASE WHEN human IS NULL THEN 'llm' ELSE 'human' END AS label_source, model FROM review WHERE human IS NOT NULL OR NOT required)
"""
_stop = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
_langs = ", ".join(f"len(list_filter(w, lambda x: x IN ({_stop(v)})))" for v in STOP_WORDS.values())
_scripts = " ".join(f"WHEN regexp_matches(head, '{re.sub(chr(92) + chr(92) + 'u(....)', lambda m: chr(int(m[1], 16)), v)}') THEN '{k}'" for k, v in SCRIPTS.items())
DETECTED = f"""
    heads AS (SELECT doc_id, substr(text, 1, 1000) AS head FROM records),
    split_ AS (SELECT doc_id, head, string_split_regex(lower(head), '[^\\p{{L}}]+') AS w FROM heads),
    lh AS (SELECT doc_id, head, [{_langs}] AS hits FROM split_),
    detected AS (SELECT doc_id, CASE {_scripts} WHEN list_max(hits) > 0 THEN ([{", ".join(f"'{k}'" for k in STOP_WORDS)}])[list_position(hits, list_max(hits))] END AS detected FROM lh)
"""

ORACLES = {
    "v_events": f"WITH {EVENTS} SELECT id, source, {_ts('created_utc')} AS created_utc, {_date('created_utc')} AS event_date, event_tag, language, score, voted_up, sentiment_label, sentiment_score, model_version FROM ev",
    "v_sentiment_daily": f"WITH {EVENTS}, {DAILY} SELECT * REPLACE ({_date('event_date')} AS event_date) FROM daily",
    "v_sentiment_by_event": f"WITH {EVENTS} SELECT event_tag, {_ts('min(created_utc)')} AS first_record_utc, {_ts('max(created_utc)')} AS last_record_utc, {COUNTS}, count(DISTINCT source) AS sources, {AUTH}, {POS}, {NET} FROM ev WHERE event_tag IS NOT NULL GROUP BY event_tag",
    "v_sentiment_by_event_source": f"WITH {EVENTS} SELECT event_tag, source, {COUNTS}, {POS}, {NEU}, {NEG}, {NET}, {CONF}, {AUTH} FROM ev GROUP BY event_tag, source",
    "v_source_coverage": f"WITH {EVENTS} SELECT source, language, {COUNTS}, {_ts('min(created_utc)')} AS first_record_utc, {_ts('max(created_utc)')} AS last_record_utc, count(DISTINCT event_tag) AS event_tags, {POS} FROM ev GROUP BY source, language",
    "v_sentiment_by_period": f"""WITH {EVENTS},
        days AS (SELECT CAST(unnest(generate_series(min(CAST(created_utc AS DATE)), max(CAST(created_utc AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM ev),
        cl AS (SELECT g AS grain, day, CASE g WHEN 'day' THEN day WHEN 'week' THEN CAST(date_trunc('week', day) AS DATE) ELSE CAST(date_trunc('month', day) AS DATE) END AS period
               FROM days, (VALUES ('day'), ('week'), ('month')) t(g)),
        c AS (SELECT grain, period, source, {COUNTS}, {POS}, {NEU}, {NEG}, {NET}, {CONF}, {AUTH} FROM ev JOIN cl ON cl.day = CAST(created_utc AS DATE) GROUP BY grain, period, source),
        spine AS (SELECT DISTINCT grain, period, s.source FROM cl, (SELECT DISTINCT source FROM ev) s)
        SELECT grain, {_date('period')} AS period, source, {_z('records')} AS records, {_z('positive')} AS positive, {_z('neutral')} AS neutral, {_z('negative')} AS negative,
               positive_share, neutral_share, negative_share, net_sentiment, avg_confidence, {_z('distinct_authors')} AS distinct_authors
        FROM spine LEFT JOIN c USING (grain, period, source)""",
    "v_source_divergence": f"""WITH {EVENTS}, s AS (SELECT event_tag, source, {_net} AS net FROM ev GROUP BY ALL),
        m AS (SELECT event_tag, count(*) AS sources, max({{'net': net, 'source': source}}) AS hi, min({{'net': net, 'source': source}}) AS lo FROM s GROUP BY event_tag HAVING count(*) >= 2)
        SELECT event_tag, sources, hi.source AS high_source, round(hi.net, 9) AS high_net, lo.source AS low_source, round(lo.net, 9) AS low_net, round(hi.net - lo.net, 9) AS gap FROM m""",
    "v_event_lift": f"WITH {EVENTS}, {LIFT} SELECT * FROM lift",
    "time_windows": f"""WITH {EVENTS}, w(window_id, a, b) AS (VALUES ('week_before', TIMESTAMP '{LAUNCH}' - INTERVAL 7 DAY, TIMESTAMP '{LAUNCH}'),
            ('launch_day', TIMESTAMP '{LAUNCH}', TIMESTAMP '{LAUNCH}' + INTERVAL 1 DAY), ('hours_48', TIMESTAMP '{LAUNCH}', TIMESTAMP '{LAUNCH}' + INTERVAL 48 HOUR),
            ('week_after', TIMESTAMP '{LAUNCH}', TIMESTAMP '{LAUNCH}' + INTERVAL 7 DAY))
        SELECT window_id, event_tag, source, count(*) AS n, count(*) FILTER (sentiment_label = 'pos') AS n_pos, count(*) FILTER (sentiment_label = 'neu') AS n_neu,
               count(*) FILTER (sentiment_label = 'neg') AS n_neg, {_share('pos')} AS share_pos, {_share('neg')} AS share_neg, round(avg(sentiment_score), 9) AS avg_score,
               round(avg({_polarity}), 9) AS mean_polarity FROM ev JOIN w ON created_utc >= a AND created_utc < b GROUP BY ALL""",
    "event_polarity": f"WITH {EVENTS} SELECT event_tag, source, count(*) AS n, {_share('pos')} AS share_pos, {_share('neg')} AS share_neg, round(avg({_polarity}), 9) AS mean_polarity FROM ev GROUP BY ALL",
    "dashboard_rollup": f"WITH {EVENTS} SELECT source, count(*) AS records, count(*) FILTER (sentiment_label = 'pos') AS positive, count(*) FILTER (sentiment_label = 'neg') AS negative, {POS}, {NET} FROM ev GROUP BY source",
    "top_languages": f"WITH {RECORDS} SELECT language, count(*) AS records FROM records GROUP BY language ORDER BY records DESC, language LIMIT 15",
    "external_baseline_join": f"WITH {EVENTS}, x(date_utc, metascore) AS (VALUES ('2024-01-12', 92), ('2024-01-13', 91), ('2024-01-20', 90)) SELECT date_utc, metascore, count(*) AS records, {NET} FROM ev JOIN x ON date_utc = {_date('created_utc')} GROUP BY ALL",
    "records_reconcile": "SELECT '' AS check_name, 0::BIGINT AS records, 0::BIGINT AS expected WHERE false",
    "check_unique_key": f"WITH {RECORDS} SELECT id, count(*) AS n FROM landing GROUP BY id HAVING count(*) > 1",
    "check_row_conditions": f"WITH {EVENTS}, {LIFT} SELECT event_tag, source, records, 'records < 50' AS broken FROM lift WHERE records >= 50 UNION ALL SELECT event_tag, source, records, 'net_lift BETWEEN -2 AND 2' FROM lift WHERE net_lift NOT BETWEEN -2 AND 2",
    "collection_quality": f"WITH {RECORDS} SELECT source, count(*) AS records, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (length(author_hash) <> 16) AS odd_hashes, count(*) FILTER (collected_at IS NULL) AS no_collected_at, count(*) FILTER (created_utc > collected_at) AS future_timestamps, round(avg(length(text)), 9) AS mean_length, count(voted_up) AS with_verdict FROM landing GROUP BY source",
    "staging_dedup_latest": f"WITH {RECORDS} SELECT id, {_ts('collected_at')} AS collected_at, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collected_at DESC NULLS LAST) AS rn FROM landing) WHERE rn = 1",
    "events_promote_merge": f"""WITH {RECORDS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collected_at DESC NULLS LAST) AS rn FROM landing) WHERE rn = 1)
        SELECT id, score, {_ts('collected_at')} AS collected_at, CASE WHEN doc_id % 2 = 1 THEN 'inserted' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'kept' END AS merge_action FROM s""",
    "coverage": f"""WITH {RECORDS}, l AS (SELECT * FROM landing WHERE doc_id % 13 <> 0)
        SELECT (SELECT count(DISTINCT id) FROM records) AS staged, (SELECT count(DISTINCT id) FROM l) AS landed, (SELECT count(*) FROM l) AS landed_rows,
               (SELECT count(*) FROM (SELECT DISTINCT id FROM records) r WHERE NOT EXISTS (FROM l WHERE l.id = r.id)) AS missing_exact,
               (SELECT count(DISTINCT id) FROM records) - (SELECT count(DISTINCT id) FROM l) AS missing""",
    "fingerprint_md5": f"WITH {EVENTS} SELECT CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'''coalesce(CAST({c} AS VARCHAR), '~')''' for c in FINGERPRINT)})), 1, 12) AS BIGINT)) AS VARCHAR) AS fingerprint, count(*) AS row_count, count(DISTINCT id) AS distinct_ids FROM ev",
    "replay_query": f"WITH {RECORDS} SELECT id, {_ts('created_utc')} AS created_utc, event_tag, voted_up FROM records WHERE event_tag = 'launch' AND created_utc >= TIMESTAMP '2024-01-11' AND created_utc < TIMESTAMP '2024-01-14'",
    "replay_schedule": f"""WITH {RECORDS}, g AS (SELECT id, created_utc, epoch_us(created_utc) - lag(epoch_us(created_utc)) OVER (ORDER BY created_utc, id) AS gap FROM records),
        z AS (SELECT id, created_utc, CASE WHEN gap IS NULL OR gap <= 0 THEN 0.0::DOUBLE ELSE least(gap / 1e6 / 86400.0, 5.0) END AS sl FROM g)
        SELECT id, {_ts('created_utc')} AS created_utc, round(sl, 9) AS sleep_s, CAST(sum(CAST(round(sl * 1e6) AS BIGINT)) OVER (ORDER BY created_utc, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_us FROM z""",
    "build_message_attrs": f"WITH {RECORDS} SELECT id, source, event_tag, strftime(created_utc, '%Y-%m-%dT%H:%M:%SZ') AS created_utc, '2024-03-01T00:00:00Z' AS replayed_at FROM records",
    "nearest_event_tag": f"WITH {RECORDS} SELECT id, event_tag FROM records",
    "window_filter": f"WITH {RECORDS} SELECT id FROM records WHERE created_utc >= TIMESTAMP '2024-01-10' AND created_utc < TIMESTAMP '2024-01-20'",
    "author_hash": f"WITH {RECORDS} SELECT id, author_hash FROM records",
    "archive_path": f"WITH {RECORDS} SELECT id, source || '/' || event_tag || '/' || strftime(created_utc, '%Y/%m/%d/%H') || '/' || md5(id) || '.jsonl.gz' AS path FROM records",
    "stub_sentiment": f"WITH {EVENTS} SELECT id, sentiment_label, sentiment_score FROM ev",
    "normalize_text": rf"""WITH {RECORDS}, a AS (SELECT id, regexp_replace(replace(text || ' @Alice' || chr(9) || chr(9) || 'https://x.org/a?b  me@site.com WWW.y.com ', chr(160), ' '), 'https?://\S+|www\.\S+', 'http', 'gi') AS t FROM records)
        SELECT id, md5(trim(regexp_replace(regexp_replace(t, '(^|[^A-Za-z0-9_])@[A-Za-z0-9_]+', '\1@user', 'g'), '\s+', ' ', 'g'))) AS digest FROM a""",
    "token_estimate": f"WITH {RECORDS} SELECT id, round(length(text) / 4.0::DOUBLE, 9) AS tokens FROM records",
    "label_alias_map": f"WITH {RECORDS} SELECT id, (['neg', 'neu', 'pos', 'neg'])[1 + doc_id % 4] AS label FROM records",
    "goemotions_collapse": f"WITH {RECORDS} SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'neg' WHEN doc_id % 3 <> 1 THEN 'pos' ELSE 'neu' END AS label FROM records",
    "validate_dead_letter": f"WITH {RECORDS} SELECT CASE WHEN doc_id % 11 = 0 THEN 'payload is not JSON' ELSE 'valid' END AS outcome, count(*) AS n FROM records GROUP BY 1",
    "gold_sample_sql": f"""WITH {RECORDS}, u AS (SELECT *, row_number() OVER (PARTITION BY source, coalesce(language, 'und') ORDER BY CAST('0x' || substr(md5(id), 1, 15) AS BIGINT), id) AS rn FROM records WHERE text IS NOT NULL AND length(trim(text)) >= 8)
        SELECT id, source, language FROM u WHERE rn <= greatest(1, 300 // (SELECT count(DISTINCT source || '|' || coalesce(language, 'und')) FROM u)) ORDER BY source, language, id LIMIT 300""",
    "prelabel_candidates": f"""WITH {RECORDS}, f AS (SELECT DISTINCT doc_id, id, text FROM landing WHERE trim(coalesce(text, '')) <> '' AND doc_id % 5 <> 0)
        SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM f) WHERE rn = 1""",
    "chunk_packs": f"WITH {RECORDS}, c AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS chunk FROM records WHERE doc_id % 3 <> 1) SELECT chunk, count(*) AS n FROM c GROUP BY 1",
    "label_counts": f"WITH {EVENTS} SELECT sentiment_label || '=' || source AS key, count(*) AS n FROM ev GROUP BY 1",
    "confusion_matrix": f"WITH {GOLD}, l(x) AS (VALUES ('pos'), ('neu'), ('neg')) SELECT a.x AS gold, b.x AS pred, count(g.id) AS n FROM l a CROSS JOIN l b LEFT JOIN gold g ON g.gold = a.x AND g.pred = b.x GROUP BY ALL",
    "classification_metrics": f"WITH {GOLD}, s AS (SELECT {SUMS} FROM gold) SELECT n, {ACC}, " + ", ".join(f"round({g(x)}, 9) AS {m}_{x}" for x in ("pos", "neu", "neg") for m, g in (("precision", _p), ("recall", _r), ("f1", _f))) + f", {_macro(_p)} AS macro_precision, {_macro(_r)} AS macro_recall, {_macro(_f)} AS macro_f1 FROM s",
    "metrics_by_slice": f"""WITH {GOLD}, x AS (SELECT gold, pred, unnest([{{'k': 'all', 's': 'all'}}, {{'k': 'language', 's': language}}, {{'k': 'en', 's': CASE WHEN lower(trim(language)) = 'en' THEN 'en' ELSE 'non-en' END}}, {{'k': 'source', 's': source}}, {{'k': 'split', 's': split}}]) AS z FROM gold),
        s AS (SELECT z.k AS slice_kind, z.s AS slice, {SUMS} FROM x GROUP BY ALL) SELECT slice_kind, slice, n, {ACC}, {_macro(_f)} AS macro_f1 FROM s""",
    "cohen_kappa": f"""WITH {GOLD}, t AS (SELECT count(*) AS n, count(*) FILTER (gold = pred) / count(*) AS o FROM gold),
        e AS (SELECT sum(a.c * b.c) AS ab FROM (SELECT gold AS k, count(*) AS c FROM gold GROUP BY 1) a JOIN (SELECT pred AS k, count(*) AS c FROM gold GROUP BY 1) b USING (k))
        SELECT n, round((o - ab / (n * n)) / (1 - ab / (n * n)), 9) AS kappa FROM t, e""",
    "class_weights": f"""WITH {GOLD}, d(position, label) AS (VALUES (0, 'neg'), (1, 'neu'), (2, 'pos'))
        SELECT position, label, round(coalesce((SELECT count(*) FROM gold) / nullif(3 * (SELECT count(*) FROM gold g WHERE g.gold = d.label), 0), 1.0), 9) AS weight FROM d""",
    "threshold_sweep": f"""WITH {GOLD}, th AS (SELECT round(0.10::DOUBLE + 0.025::DOUBLE * i, 3) AS threshold FROM range(0, 17) r(i)),
        x AS (SELECT threshold, gold, CASE WHEN p_neg >= threshold THEN 'neg' WHEN p_pos > p_neu THEN 'pos' ELSE 'neu' END AS pred FROM gold, th),
        s AS (SELECT threshold, {SUMS} FROM x GROUP BY threshold) SELECT threshold, n, {ACC}, round({_f('neg')}, 9) AS f1_neg, {_macro(_f)} AS macro_f1 FROM s""",
    "review_flags": f"WITH {GOLD} SELECT id, pred = 'neg' OR p_pos < 0.6 AS review_required FROM gold",
    "oversample": f"WITH {GOLD} SELECT id, CAST(c AS INTEGER) AS copy FROM gold, range(1, 4) r(c)",
    "view_assertions": "SELECT '' AS view_name, '' AS check_name, 0::BIGINT AS violations WHERE false",
    "period_report": f"""WITH {EVENTS} SELECT {_date("date_trunc('week', created_utc)")} AS period, source, count(*) AS records, {NET}, 2 AS weekday, CAST(day(date_trunc('week', created_utc)) AS INTEGER) AS day
        FROM ev GROUP BY date_trunc('week', created_utc), source HAVING count(*) >= 20""",
    "tokens": f"WITH {EVENTS} SELECT id, md5(array_to_string(list_filter(t, lambda w: w <> ''), ' ')) AS digest FROM records JOIN tokens USING (doc_id)",
    "fit_to_tokens": rf"""WITH {RECORDS}, n AS (SELECT id, length(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), 'https?://\S+|www\.\S+', 'http', 'gi'), '(^|[^A-Za-z0-9_])@[A-Za-z0-9_]+', '\1@user', 'g'), '\s+', ' ', 'g'))) AS c FROM records)
        SELECT id, CAST(CASE WHEN c <= 960 THEN c ELSE 959 END AS INTEGER) AS kept FROM n""",
    "corpus_label_maps": f"""WITH {RECORDS} SELECT id, (['neg', 'pos'])[1 + doc_id % 2] AS sst2, (['neg', 'neu', 'pos'])[1 + doc_id % 3] AS tweet_eval, (['neg', 'neu', 'pos'])[1 + doc_id % 3] AS sentiment140, (['pos', 'neu', 'neg'])[1 + doc_id % 3] AS clapai FROM records""",
    "score_vectors": f"""WITH {GOLD} SELECT id, (['neg', 'neu', 'pos'])[list_position([p_neg, p_neu, p_pos], greatest(p_neg, p_neu, p_pos))] AS label,
        round(exp(greatest(p_neg, p_neu, p_pos)) / (exp(p_neg) + exp(p_neu) + exp(p_pos)), 9) AS score FROM gold""",
    "gold_pred_join": f"WITH {GOLD} SELECT id, gold, CASE WHEN doc_id % 3 = 0 THEN 'neu' ELSE pred END AS pred FROM gold WHERE doc_id % 4 <> 0",
    "best_threshold": f"""WITH {GOLD}, th AS (SELECT round(0.10::DOUBLE + 0.025::DOUBLE * i, 3) AS threshold FROM range(0, 17) r(i)),
        x AS (SELECT threshold, gold, CASE WHEN p_neg >= threshold THEN 'neg' WHEN p_pos > p_neu THEN 'pos' ELSE 'neu' END AS pred FROM gold, th),
        s AS (SELECT threshold, {SUMS} FROM x GROUP BY threshold), m AS (SELECT threshold, {_macro(_f)} AS macro_f1 FROM s) SELECT threshold, macro_f1 FROM m ORDER BY macro_f1 DESC, threshold DESC LIMIT 1""",
    "split_allocation": f"""WITH {GOLD}, r AS (SELECT id, language, gold AS label FROM gold), {_pick("h", "r", "60")}, rest AS (SELECT * FROM r WHERE id NOT IN (FROM h)), {_pick("d", "rest", "30")}
        SELECT id, language, label, CASE WHEN id IN (FROM h) THEN 'holdout' WHEN id IN (FROM d) THEN 'dev' ELSE 'train' END AS split FROM r""",
    "gold_merge": f"""WITH {REVIEW}, hu AS (SELECT * FROM done WHERE label_source = 'human'), need AS (SELECT greatest(0, 120 - count(*)) AS n FROM old WHERE split = 'holdout'),
        {_pick("hh", "hu", "SELECT n FROM need")}, hr AS (SELECT * FROM hu WHERE id NOT IN (FROM hh)), {_pick("hd", "hr", "20")},
        ml AS (SELECT * FROM done WHERE label_source = 'llm'), {_pick("mh", "ml", "SELECT greatest(0, n - (SELECT count(*) FROM hh)) FROM need")},
        mr AS (SELECT * FROM ml WHERE id NOT IN (FROM mh)), {_pick("md", "mr", "SELECT greatest(0, 20 - (SELECT count(*) FROM hd))")}
        SELECT id, language, label, 'human' AS label_source, split FROM old UNION ALL
        SELECT id, language, label, label_source, CASE WHEN id IN (FROM hh) OR id IN (FROM mh) THEN 'holdout' WHEN id IN (FROM hd) OR id IN (FROM md) THEN 'dev' ELSE 'train' END FROM done""",
    "prelabel_agreement": f"""WITH {REVIEW}, a AS (SELECT label, model FROM done WHERE label_source = 'human'), t AS (SELECT count(*) AS n, count(*) FILTER (label = model) / count(*) AS o FROM a),
        e AS (SELECT sum(x.c * y.c) AS ab FROM (SELECT label AS k, count(*) AS c FROM a GROUP BY 1) x JOIN (SELECT model AS k, count(*) AS c FROM a GROUP BY 1) y USING (k))
        SELECT n, round(o, 9) AS accuracy, round((o - ab / (n * n)) / (1 - ab / (n * n)), 9) AS kappa, (SELECT count(*) FROM review WHERE required AND human IS NULL) AS dropped_unreviewed FROM t, e""",
    "corpus_mix": f"""WITH {GOLD} SELECT id, sentiment_label AS label, 'pool' AS source FROM {_proportional("ev", "sentiment_label", 90, 33)} WHERE trim(text) <> ''
        UNION ALL SELECT id, gold, source FROM gold, range(2) WHERE split = 'train'""",
    "stage2_rows": f"""WITH {GOLD} SELECT id, gold AS label, source FROM gold, range(3) WHERE split = 'train'
        UNION ALL SELECT id, sentiment_label, 'pool' FROM {_proportional("ev", "sentiment_label", 60, 33)} WHERE trim(text) <> ''""",
    "balanced_sample": f"WITH {EVENTS} SELECT id, language, sentiment_label AS label FROM ev QUALIFY row_number() OVER (PARTITION BY language, sentiment_label ORDER BY {_h(33)}, id) <= 4",
    "proportional": f"WITH {GOLD} SELECT id, gold FROM {_proportional('gold', 'gold', 100, 42)}",
    "stratified_sample": f"""WITH {RECORDS}, k AS (SELECT greatest(1, 50 // count(*)) AS q FROM (SELECT DISTINCT source, language FROM records)), r AS (
        SELECT id, source, language, {_h(42)} AS h, row_number() OVER (PARTITION BY source, language ORDER BY {_h(42)}, id) AS rn FROM records)
        SELECT id, source, language FROM r, k ORDER BY rn <= q DESC, h, id LIMIT 50""",
    "stratified_split": f"""WITH {GOLD}, r AS (SELECT id, gold, row_number() OVER (PARTITION BY gold ORDER BY {_h(42)}, id) AS rn, count(*) OVER (PARTITION BY gold) AS n FROM gold)
        SELECT id, gold, CASE WHEN n > 1 AND rn <= greatest(1, least(n - 1, round_even(n * 0.2, 0))) THEN 'eval' ELSE 'train' END AS part FROM r""",
    "reservoir_sample": f"WITH {RECORDS} SELECT id, language, source FROM records QUALIFY row_number() OVER (PARTITION BY language, source ORDER BY {_h(42)}, id) <= 10",
    "time_slices": f"""WITH {RECORDS}, w AS (SELECT source AS channel, min(created_utc) AS a, max(created_utc) + INTERVAL 1 SECOND AS b FROM records GROUP BY 1),
        s AS (SELECT channel, b, unnest(generate_series(a, b - INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)) AS s FROM w)
        SELECT channel, {_ts("s")} AS slice_start, {_ts("least(s + INTERVAL 6 HOUR, b)")} AS slice_end FROM s""",
    "video_ids": f"WITH {RECORDS} SELECT 'v' || id AS id FROM records WHERE event_tag = 'launch' AND doc_id % 5 <> 0",
    "stored_merge": f"""WITH {RECORDS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collected_at DESC NULLS LAST) AS rn FROM landing) WHERE rn = 1)
        SELECT id, score, {_ts('collected_at')} AS collected_at FROM s""",
    "event_time_windows": f"""WITH {EVENTS} SELECT strftime(date_trunc('day', created_utc), '%Y-%m-%d %H:%M:%S') AS window_start, source, sentiment_label, count(*) AS records
        FROM ev WHERE doc_id % 11 <> 0 GROUP BY ALL""",
    "mark_review": f"""WITH {GOLD}, r AS (SELECT id, language, pred AS label, p_pos FROM gold WHERE doc_id % 2 = 1), need AS (SELECT greatest(0, 60 - count(*)) AS n FROM gold WHERE doc_id % 20 = 0 AND split = 'holdout'),
        {_pick("h", "r", "SELECT n FROM need")}, rest AS (SELECT * FROM r WHERE id NOT IN (FROM h)), {_pick("d", "rest", "20")}
        SELECT id, label AS label_llm, label = 'neg' OR p_pos < 0.2 OR id IN (FROM h) OR id IN (FROM d) AS review_required FROM r""",
    "prelabel_rows": f"""WITH {RECORDS} SELECT id, coalesce(language, '') AS language, event_tag, '' AS label_llm, '' AS llm_confidence, source, {_ts('created_utc')} AS created_utc
        FROM (SELECT *, row_number() OVER (PARTITION BY trim(text, ' ' || chr(9) || chr(10) || chr(13)) ORDER BY doc_id) AS rn FROM records WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND doc_id % 5 <> 0) WHERE rn = 1""",
    "comment_trees": """WITH RECURSIVE replies AS (
            SELECT conv_id || ':' || turn AS id, CASE WHEN turn > 0 THEN conv_id || ':' || ((turn - 1) // 2) END AS parent_id FROM conversations WHERE conv_id % 9 <> 4 OR turn > 0
        ), walk(id, parent_id, root, depth) AS (
            SELECT r.id, r.parent_id, p.id, 0 FROM replies r JOIN replies p ON r.parent_id = p.id WHERE p.parent_id IS NULL
            UNION ALL SELECT r.id, r.parent_id, w.root, w.depth + 1 FROM replies r JOIN walk w ON r.parent_id = w.id WHERE w.depth < 2
        ) SELECT id, parent_id, root, CAST(depth AS INTEGER) AS depth FROM walk""",
    "search_records": f"""WITH RECURSIVE turns AS (
            SELECT *, conv_id || ':' || turn AS id, CASE WHEN turn > 0 THEN conv_id || ':' || ((turn - 1) // 2) END AS parent_id,
                   TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS made, coalesce(text, '') AS body FROM conversations
        ), walk AS (
            SELECT id, parent_id, conv_id, turn, made, trim(' A title' || chr(10) || chr(10) || body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, 0 AS up
            FROM turns WHERE turn = 0 AND conv_id >= 2 AND conv_id % 9 <> 4
            UNION ALL SELECT t.id, t.parent_id, t.conv_id, t.turn, t.made, t.body, up + 1 FROM turns t JOIN walk w ON t.parent_id = w.id WHERE up <= 2
        ) SELECT 'reddit:' || id AS id, parent_id, {_ts("made")} AS created_utc, substr(sha256(CASE WHEN turn % 4 > 0 THEN 'w' || turn ELSE '[deleted]' END || '{SALT}'), 1, 16) AS author_hash,
               md5(said) AS digest, conv_id AS score, 'r' || (conv_id % 5) AS context_id, 'launch' AS event_tag FROM walk""",
    "profile_enrich": f"WITH {RECORDS} SELECT language AS declared, count(*) AS n, TRUE AS right FROM records WHERE doc_id % 11 <> 0 GROUP BY ALL",
    "first_by_id_or_text": """WITH RECURSIVE r AS (
            SELECT doc_id, (doc_id // 2000) || ':' || (doc_id * 7919 % 1009 % 400) AS i, (doc_id // 3000) || ':' || (doc_id * 104729 % 997 % 500) AS t, row_number() OVER (ORDER BY doc_id) AS n FROM documents
        ), walk(n, doc_id, keep, ids, texts) AS (
            SELECT n, doc_id, TRUE, [i], [t] FROM r WHERE n = 1
            UNION ALL
            SELECT r.n, r.doc_id, NOT (list_contains(ids, i) OR list_contains(texts, t)),
                   CASE WHEN list_contains(ids, i) OR list_contains(texts, t) THEN ids ELSE list_append(ids, i) END,
                   CASE WHEN list_contains(ids, i) OR list_contains(texts, t) THEN texts ELSE list_append(texts, t) END
            FROM walk JOIN r ON r.n = walk.n + 1
        ) SELECT doc_id FROM walk WHERE keep""",
    "language_profiles": "SELECT lang AS language, count(*) AS n, TRUE AS right FROM documents WHERE doc_id % 2 = 1 GROUP BY ALL",
    "completeness_gate": f"""WITH {RECORDS} SELECT count(*) AS staged, count(*) FILTER (doc_id % 13 <> 0) AS landed, count(*) FILTER (doc_id % 13 = 0) AS missing, count(*) FILTER (doc_id % 13 = 0) = 0 AS complete FROM records""",
    "detect_language": f"WITH {RECORDS}, {DETECTED} SELECT id, detected AS language FROM records JOIN detected USING (doc_id)",
    "stream_enrich": f"""WITH {EVENTS}, {DETECTED} SELECT id, source, parent_id, created_utc, collected_at, author_hash, detected AS language, score, context_id, event_tag, voted_up,
        sentiment_label, sentiment_score, model_version, processed_at FROM (SELECT *, NULL::VARCHAR AS parent_id, TIMESTAMP '{PROCESSED}' AS processed_at FROM ev) JOIN detected USING (doc_id) WHERE doc_id % 11 <> 0""",
}
