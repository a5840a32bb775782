"""SQL fragments (DuckDB) that rebuild each stage from the ``events`` view."""

from __future__ import annotations

from failwatch import settings as S
from registry.adapter import BASE_US, COPY_SEQ, IMAGES, SQUEEZE, STACKS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expr: str, name: str) -> str:
    """Six decimals, with halves nudged so that both engines round the same way."""
    return f"floor(({expr}) * 1e6 + 0.5001) / 1e6 AS {name}"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def contains_any(expr: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(p)})" for p in phrases) + ")"


LEVEL = lambda e: (
    "CASE " + " ".join(
        f"WHEN {contains_any(f'upper({e})', words)} THEN {q(level)}" for words, level in S.LEVEL_RULES
    ) + f" ELSE {q(S.DEFAULT_LEVEL)} END"
)
STACK_OF = lambda e: (
    "CASE "
    + " ".join(f"WHEN {contains_any(f'lower({e})', words)} THEN {q(s)}" for words, s in S.STACK_RULES)
    + f" WHEN starts_with(lower({e}), {q(S.GO_TAG_PREFIX)}) THEN 'Go/net_http' ELSE {q(S.UNKNOWN_STACK)} END"
)

BASE = f"""
base AS (
  SELECT event_id AS seq,
         {BASE_US} + (epoch_us(ts) - {BASE_US}) // {SQUEEZE} AS ts_us,
         'svc-' || (user_id % 8) AS service_name,
         {_list(STACKS)}[(user_id % 8 % 5) + 1] AS stack,
         CASE WHEN event_id % 97 = 0 THEN '  '
              WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'ERROR: out of memory (request #' || event_id || ')'
              WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'WARN memory heap usage increasing ' || event_id || ' MB!'
              WHEN event_type = 'error' THEN 'ERROR CPU spike on core ' || event_id
              ELSE 'INFO ' || event_type || ' request ' || event_id || ' served' END AS log_message,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN value > 160 THEN value ELSE value / 2 END AS ram_percent,
         (event_id * 37 % 1300) / 10.0::DOUBLE AS cpu_percent,
         value * 5 AS heap_mb_used,
         event_id // 20 AS gc_count,
         CASE WHEN event_type = 'error' AND value > 20 THEN 'FAILURE' ELSE 'NORMAL' END AS ground_truth_label,
         user_id, event_type, value
  FROM events
)"""

RAW = BASE + f""",
raw AS (
  SELECT *, {LEVEL('log_message')} AS log_level FROM (
    SELECT * EXCLUDE (user_id, event_type, value) FROM base
    UNION ALL
    SELECT * EXCLUDE (user_id, event_type, value) REPLACE (seq + {COPY_SEQ} AS seq, 1.0 AS ram_percent)
    FROM base WHERE seq % 50 = 0)
)"""

DEDUPED = RAW + """,
deduped AS (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY ts_us, service_name, log_message ORDER BY seq) = 1
)"""

FILLED = DEDUPED + """,
filled AS (
  SELECT * REPLACE (
    last_value(ram_percent IGNORE NULLS) OVER f AS ram_percent,
    last_value(cpu_percent IGNORE NULLS) OVER f AS cpu_percent,
    last_value(heap_mb_used IGNORE NULLS) OVER f AS heap_mb_used,
    last_value(gc_count IGNORE NULLS) OVER f AS gc_count)
  FROM deduped
  WINDOW f AS (PARTITION BY service_name ORDER BY ts_us, seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

CLEANED = FILLED + r""",
cleaned AS (
  SELECT * REPLACE (
    CASE WHEN ram_percent IS NULL THEN NULL ELSE least(greatest(ram_percent, 0.0), 100.0) END AS ram_percent,
    CASE WHEN cpu_percent IS NULL THEN NULL ELSE least(greatest(cpu_percent, 0.0), 100.0) END AS cpu_percent,
    CASE WHEN heap_mb_used IS NULL THEN NULL ELSE least(greatest(heap_mb_used, 0.0), 10000.0) END AS heap_mb_used,
    trim(regexp_replace(log_message, '[^A-Za-z0-9 .:\[\]]+', '', 'g')) AS log_message)
  FROM filled WHERE trim(log_message) <> ''
)"""

TEMPLATED = CLEANED + r""",
templated AS (
  SELECT *, length(log_template) AS template_id FROM (
    SELECT *, array_to_string(list_transform(
        regexp_split_to_array(log_message, '\s+'),
        lambda t: CASE WHEN regexp_matches(t, '\d') THEN '<*>' ELSE t END), ' ') AS log_template
    FROM cleaned)
)"""


def corpora(sizes: list[int]) -> str:
    sentences = S.FAILURE_SENTENCES + S.EXTRA_SENTENCES
    rows = [f"({s}, {i}, {q(sentences[i])})" for s in sizes for i in range(s)]
    return "corpora(size, ref_id, body) AS (VALUES " + ", ".join(rows) + ")"


def similarity(sizes: list[int]) -> str:
    return f"""
{corpora(sizes)},
docs AS (
  SELECT size, 'r' AS side, ref_id::VARCHAR AS doc, body FROM corpora
  UNION ALL
  SELECT size, 't', log_template, log_template
  FROM (SELECT DISTINCT log_template FROM templated), (SELECT DISTINCT size FROM corpora)
),
doc_words AS (
  SELECT size, side, doc, regexp_extract_all(lower(body), '[a-z0-9_]{{2,}}') AS w FROM docs
),
tf AS (
  SELECT size, side, doc, term, count(*) AS tf FROM (
    SELECT size, side, doc, unnest(list_concat(w, list_transform(range(1, len(w)),
           lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM doc_words)
  GROUP BY ALL
),
vocab AS (
  SELECT size, term, count(*) AS df FROM tf GROUP BY size, term
  QUALIFY row_number() OVER (PARTITION BY size ORDER BY sum(tf) DESC, term) <= 5000
),
n_docs AS (SELECT size, count(*) AS n FROM docs GROUP BY size),
raw_weight AS (
  SELECT size, side, doc, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw
  FROM tf JOIN vocab USING (size, term) JOIN n_docs USING (size)
),
weight AS (
  SELECT size, side, doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY size, side, doc)) AS weight
  FROM raw_weight
),
similarity AS (
  SELECT d.size, d.doc AS log_template, coalesce(max(cosine), 0.0) AS similarity
  FROM (SELECT size, doc FROM docs WHERE side = 't') d LEFT JOIN (
    SELECT t.size, t.doc, r.doc AS ref, sum(t.weight * r.weight) AS cosine
    FROM weight t JOIN weight r ON t.size = r.size AND t.term = r.term AND t.side = 't' AND r.side = 'r'
    GROUP BY t.size, t.doc, r.doc) c USING (size, doc)
  GROUP BY d.size, d.doc
)"""


SIMILARITY = TEMPLATED + "," + similarity([len(S.FAILURE_SENTENCES)])

_MEM = contains_any("upper(log_template)", S.MEMORY_PHRASES)
_CPU = contains_any("upper(log_template)", S.CPU_PHRASES)
KEYWORD_TYPE = f"CASE WHEN {_MEM} THEN 'memory_leak' WHEN {_CPU} THEN 'cpu_spike' END"

GC_JUMP = """gc_count - first_value(gc_count) OVER (
    PARTITION BY service_name ORDER BY ts_us, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
POINTS = " + ".join(
    f"CASE WHEN {c} > {limit} THEN {points} ELSE 0 END" for c, limit, points in S.METRIC_POINTS
)

SCORED = TEMPLATED + f""",
scored AS (
  SELECT *, {POINTS} + CASE WHEN gc_jump > 3 THEN 2 ELSE 0 END AS metric_score
  FROM (SELECT *, {GC_JUMP} AS gc_jump FROM templated)
)"""

CLASSIFIED = SIMILARITY + f""",
scored AS (
  SELECT *, {POINTS} + CASE WHEN gc_jump > 3 THEN 2 ELSE 0 END AS metric_score
  FROM (SELECT *, {GC_JUMP} AS gc_jump FROM templated)
),
layered AS (
  SELECT *, CASE WHEN kind IS NOT NULL THEN 'keyword'
                 WHEN similarity > 0.12 THEN 'tfidf_semantic' ELSE 'normal' END AS layer
  FROM (SELECT s.*, {KEYWORD_TYPE} AS kind, similarity FROM scored s JOIN similarity USING (log_template))
),
classified AS (
  SELECT * EXCLUDE (kind, layer, similarity),
    CASE WHEN layer <> 'normal' OR metric_score >= 3 THEN 'FAILURE' ELSE 'NORMAL' END AS hybrid_label,
    CASE WHEN layer = 'normal' AND metric_score >= 3 THEN 'metric_fusion'
         WHEN layer <> 'normal' AND metric_score >= 2 THEN layer || '_metric_confirmed'
         ELSE layer END AS detection_layer,
    CASE WHEN layer = 'normal' AND metric_score >= 3 THEN 'metric_only' ELSE coalesce(kind, 'none') END AS failure_type
  FROM layered
)"""

WINDOWS = CLASSIFIED + """,
stepped AS (
  SELECT *, CASE WHEN gc_count > lag(gc_count) OVER s THEN 1 ELSE 0 END AS gc_step,
         min((ts_us, seq)) OVER (PARTITION BY service_name) AS service_first
  FROM classified WINDOW s AS (PARTITION BY service_name ORDER BY ts_us, seq)
),
framed AS (
  SELECT *, count(*) OVER f AS window_rows,
    last_value(ram_percent) OVER f - first_value(ram_percent) OVER f AS memory_growth,
    CASE WHEN count(heap_mb_used) OVER f > 1
         THEN (last_value(heap_mb_used) OVER f - first_value(heap_mb_used) OVER f) / (count(heap_mb_used) OVER f - 1)
         ELSE 0.0 END AS heap_rate,
    (sum(gc_step) OVER f - first_value(gc_step) OVER f)::BIGINT AS gc_spike_count,
    (max(ts_us) OVER f - min(ts_us) OVER f) / 1e6 AS window_duration_seconds,
    avg(ram_percent) OVER f AS ram_mean, max(ram_percent) OVER f AS ram_max,
    stddev_samp(ram_percent) OVER f AS ram_std,
    avg(cpu_percent) OVER f AS cpu_mean, max(cpu_percent) OVER f AS cpu_max,
    max(heap_mb_used) OVER f AS heap_max,
    CASE WHEN max(CASE WHEN ground_truth_label = 'FAILURE' THEN 1 ELSE 0 END) OVER f = 1
         THEN 'FAILURE' ELSE 'NORMAL' END AS window_label
  FROM stepped
  WINDOW f AS (PARTITION BY service_name ORDER BY ts_us RANGE BETWEEN 300000000 PRECEDING AND 1 PRECEDING)
),
windows AS (
  SELECT *, 'ground_truth' AS label_source,
         row_number() OVER (ORDER BY service_first, ts_us, seq) AS window_id
  FROM framed WHERE window_rows >= 3
)"""

TRENDS = WINDOWS + """,
minute_counts AS (
  SELECT *, sum(CASE WHEN hybrid_label = 'FAILURE' THEN 1 ELSE 0 END) OVER (
      PARTITION BY service_name ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)::BIGINT AS failures_1m,
    row_number() OVER (PARTITION BY service_name ORDER BY ts_us, seq) AS pos,
    coalesce((ram_std - lag(ram_std, 3) OVER (PARTITION BY service_name ORDER BY ts_us, seq)) / 3, 0.0) AS ram_std_trend
  FROM windows
),
trends AS (
  SELECT *,
    CASE WHEN count(*) OVER f > 1 THEN regr_slope(failures_1m, pos) OVER f ELSE 0.0 END AS trend_slope_5m,
    (max(failures_1m) OVER f)::DOUBLE AS trend_max_failures_5m,
    coalesce(var_samp(failures_1m) OVER f, 0.0) AS trend_variance_5m,
    CASE WHEN count(*) OVER t > 1 THEN regr_slope(failures_1m, pos) OVER t ELSE 0.0 END AS trend_slope_10m,
    (max(failures_1m) OVER t)::DOUBLE AS trend_max_failures_10m,
    coalesce(var_samp(failures_1m) OVER t, 0.0) AS trend_variance_10m
  FROM minute_counts
  WINDOW f AS (PARTITION BY service_name ORDER BY ts_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW),
         t AS (PARTITION BY service_name ORDER BY ts_us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW)
)"""

CONTAINER = f"""
containers AS (
  SELECT event_id AS seq,
         {BASE_US} + (epoch_us(ts) - {BASE_US}) // {SQUEEZE} AS ts_us,
         'svc-' || (user_id % 8) AS name,
         {_list(IMAGES)}[(user_id % 6) + 1] AS image_tag,
         (event_id * 1000 + 700) - (event_id * 1000 + event_id % 7 * 10) AS cpu_delta,
         CASE WHEN event_id % 101 = 0 THEN 0 ELSE 7777 END AS system_delta,
         greatest(event_id % 5, 1) AS cores,
         CASE WHEN event_id % 107 <> 0 THEN floor(value * 1000000) + 1 END AS mem_usage,
         CASE WHEN event_id % 103 = 0 THEN 0 ELSE 536870912 END AS mem_limit
  FROM events
),
container_metrics AS (
  SELECT *, CASE WHEN system_delta > 0 THEN round(cpu_delta / system_delta * cores * 100.0::DOUBLE, 4) ELSE 0.0 END AS cpu_percent,
         CASE WHEN mem_limit > 0 THEN round(mem_usage / mem_limit * 100.0::DOUBLE, 4) ELSE 0.0 END AS ram_percent,
         round(mem_usage / 1048576.0::DOUBLE, 4) AS heap_mb_used
  FROM containers WHERE mem_usage IS NOT NULL
)"""

LINES = BASE + """,
lines AS (
  SELECT service_name AS name, ts_us - ts_us % 60000000 AS tick, seq AS line_no, log_message AS line FROM base
),
last_lines AS (
  SELECT name, tick, string_agg(line, ' | ' ORDER BY line_no) AS log_message
  FROM (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY name, tick ORDER BY line_no DESC) <= 3)
  GROUP BY name, tick
)"""
