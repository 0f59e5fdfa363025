"""The queries of ``queries.py`` in plain SQL over the same tables."""

from __future__ import annotations

# Views that stand for the fixtures, as common table expressions.
EV = """ev AS (
  SELECT event_id, event_type, user_id, props, CAST(user_id % 4 AS INTEGER) AS part,
         epoch_us(ts) AS t, concat_ws('|', event_id, event_type, props) AS payload
  FROM events)"""

RUNS = """runs(test_id, topic) AS (
  VALUES ('faithful', 'src'), ('faithful', 'dst'), ('dropped', 'src'), ('dropped', 'dst'),
         ('edited', 'src'), ('edited', 'dst'))"""

MSG = f"""{EV}, {RUNS}, msg AS (
  SELECT test_id, topic, part AS "partition", event_id AS "offset",
         CASE WHEN test_id = 'edited' AND topic = 'dst' AND event_id = 777 THEN payload || '!'
              ELSE payload END AS payload
  FROM ev CROSS JOIN runs
  WHERE NOT (test_id = 'dropped' AND topic = 'dst' AND event_id = 777))"""

MARKED = f"""{MSG}, marks AS (
  SELECT test_id, topic, CAST(p AS INTEGER) AS "partition", CAST(1000000000000 AS BIGINT) AS "offset",
         'end-of-stream' AS payload
  FROM runs CROSS JOIN range(4) AS r(p)
  WHERE NOT (test_id = 'dropped' AND topic = 'dst' AND p = 3)),
marked AS (SELECT * FROM msg UNION ALL SELECT * FROM marks)"""

POS = f"""{MSG}, pos AS (
  SELECT *, row_number() OVER (PARTITION BY test_id, topic ORDER BY "partition", "offset") AS position
  FROM msg)"""

LINES = """parts AS (
  SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS p FROM documents),
ls AS (
  SELECT doc_id, unnest(range(len(q))) AS line_no, unnest(q) AS line
  FROM (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS q FROM parts)),
topic_lines AS (
  SELECT 'lines' AS topic, CAST(doc_id % 4 AS INTEGER) AS "partition",
         row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id, line_no) - 1 AS "offset", line AS payload
  FROM ls)"""


def _digests(positions: str, item: str = "payload") -> str:
    return f"""SELECT test_id, topic, (position - 1) // 1000 AS slice, count(*) AS messages,
    md5(string_agg({item}, '' ORDER BY position)) AS digest
  FROM {positions} GROUP BY ALL"""


def _compared(item: str = "payload") -> str:
    return f"{POS}, {_slices(item)}"


def _slices(item: str) -> str:
    return f"""digests AS ({_digests('pos', item)}),
compared AS (
  SELECT coalesce(s.test_id, d.test_id) AS test_id, coalesce(s.slice, d.slice) AS slice,
         coalesce(s.digest, md5('')) AS source_digest, coalesce(s.messages, 0) AS source_messages,
         coalesce(d.digest, md5('')) AS destination_digest, coalesce(d.messages, 0) AS destination_messages,
         coalesce(s.digest, md5('')) = coalesce(d.digest, md5('')) AS same
  FROM (SELECT * FROM digests WHERE topic = 'src') s
  FULL JOIN (SELECT * FROM digests WHERE topic = 'dst') d ON s.test_id = d.test_id AND s.slice = d.slice)"""


def _report(item: str = "payload") -> str:
    return f"{POS}, {_verdict(item)}"


def _verdict(item: str = "payload") -> str:
    return f"""{_slices(item)}, totals AS (
  SELECT test_id, CAST(sum(source_messages) AS BIGINT) AS source_total,
         CAST(sum(destination_messages) AS BIGINT) AS destination_total,
         bool_and(same) AS order_preserved, min(slice) FILTER (WHERE NOT same) AS first_difference
  FROM compared GROUP BY test_id),
report AS (
  SELECT test_id, 'FOUND' AS status, source_total, destination_total,
         source_total = destination_total AS same_amount, order_preserved, first_difference,
         ' - Destination topic contains the same amount of messages as Source topic(' || source_total
           || ' out of ' || destination_total || '): '
           || CASE WHEN source_total = destination_total THEN 'TRUE' ELSE 'FALSE' END AS count_line,
         ' - Destination topic preserves ordering of Source topic: '
           || CASE WHEN order_preserved THEN 'TRUE' ELSE 'FALSE' END AS order_line
  FROM totals)"""


MISSING = """SELECT 'absent' AS test_id, 'NO_SUCH_TEST' AS status, NULL AS source_total,
  NULL AS destination_total, NULL AS same_amount, NULL AS order_preserved, NULL AS first_difference,
  'There is no such test ''absent''' AS count_line, NULL AS order_line"""

REC = f"""{EV}, rec AS (
  SELECT event_id, event_type AS topic, CAST(user_id % 4 AS VARCHAR) AS "partition",
         CAST(user_id % 2 AS VARCHAR) AS consumerid, t AS created,
         t + (event_id * 37) % 5000 AS consumed, t + (event_id * 91) % 7000 AS produced, t AS arrived_us
  FROM ev)"""

PAIRS = f"""{REC}, pairs AS (
  SELECT topic, "partition", consumerid, 'created-consumed' AS eventname, consumed - created AS latency, arrived_us FROM rec
  UNION ALL
  SELECT topic, "partition", consumerid, 'created-produced', produced - created, arrived_us FROM rec
  UNION ALL
  SELECT topic, "partition", consumerid, 'consumed-produced', produced - consumed, arrived_us FROM rec)"""

BUCKETS = f"""{PAIRS}, buckets AS (
  SELECT topic, "partition", consumerid, eventname, arrived_us // 1000000 AS "second",
         CAST(sum(latency) AS BIGINT) AS total, count(*) AS cnt
  FROM pairs GROUP BY ALL)"""

WINDOWS = [("second", 10), ("second", 30), ("minute", 1), ("minute", 5), ("minute", 10), ("minute", 15)]


def _rolling(unit: str, length: int, source: str = "buckets") -> str:
    span = length * (1 if unit == "second" else 60)
    return f"""SELECT topic, "partition", consumerid, eventname, ending AS "second",
    'avg{length}{unit}' AS operation, CAST(sum(total) AS BIGINT) // CAST(sum(cnt) AS BIGINT) AS value,
    CAST(sum(cnt) AS BIGINT) AS cnt
  FROM (SELECT *, unnest(range("second" + 1, "second" + {span} + 1)) AS ending FROM {source})
  GROUP BY ALL"""


def _spans(unit: str, length: int) -> str:
    """Windows that end from one change of their buckets to the next, cut moment every sixth hour."""
    span = length * (1 if unit == "second" else 60)
    series = 'topic, "partition", consumerid, eventname'
    return f"""SELECT {series}, 'avg{length}{unit}' AS operation, greatest(moment, k * 21600) AS "from",
    least(til, (k + 1) * 21600) AS "until", total // cnt AS value, cnt
  FROM (
    SELECT *, unnest(range(moment // 21600, (til - 1) // 21600 + 1)) AS k
    FROM (
      SELECT {series}, moment, lead(moment) OVER w AS til, CAST(sum(dt) OVER w AS BIGINT) AS total, CAST(sum(dc) OVER w AS BIGINT) AS cnt
      FROM (
        SELECT {series}, moment, sum(dt) AS dt, sum(dc) AS dc FROM (
          SELECT {series}, "second" + 1 AS moment, total AS dt, cnt AS dc FROM buckets
          UNION ALL SELECT {series}, "second" + 1 + {span}, -total, -cnt FROM buckets)
        GROUP BY ALL)
      WINDOW w AS (PARTITION BY {series} ORDER BY moment))
    WHERE cnt > 0)"""


RESULTS = f"""{BUCKETS}, results AS (
  {_rolling('second', 10)}
  UNION ALL
  {_rolling('second', 30)}),
charted AS (SELECT * FROM results WHERE operation = 'avg10second')"""

LONG = f"""{RESULTS}, long AS (
  SELECT topic, "partition", consumerid, eventname, "second", operation, 'value' AS field, value AS y FROM charted
  UNION ALL
  SELECT topic, "partition", consumerid, eventname, "second", operation, 'count', cnt FROM charted)"""


def _points(line: str) -> str:
    return f"""WITH {LONG}
SELECT {line}, "second" // 3600 * 3600 AS hour,
  string_agg("second" || ':' || eventname || ':' || y, ';' ORDER BY "second", eventname, y) AS points
FROM long GROUP BY {line}, hour"""


FRAMES = f"""{EV}, frames AS (
  SELECT event_id, user_id % 10 = 0 AS short, event_type = 'error' AS wrong, event_type, props,
         CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 900000 END AS schema_id
  FROM ev),
split AS (
  SELECT event_id, event_type, props,
         CASE WHEN NOT short AND NOT wrong THEN schema_id END AS schema_id,
         CASE WHEN NOT short AND NOT wrong THEN hex(encode(props)) END AS body,
         CASE WHEN short THEN 'truncated' WHEN wrong THEN 'unknown magic byte' END AS problem
  FROM frames)"""


def _synthetic(shape: tuple[str, int, int]) -> str:
    seed, shortest, longest = shape
    return f"""{EV}, sized AS (
  SELECT event_id AS id, {shortest} + CAST('0x' || substr(md5('{seed}:' || event_id), 1, 8) AS BIGINT)
         % {longest - shortest + 1} AS n FROM ev)"""


def _text(seed: str, row_id: str, length: str) -> str:
    return f"""substr(array_to_string(list_transform(range(0, ({length} - 1) // 32 + 1),
      lambda b: md5('{seed}:' || {row_id} || ':' || b)), ''), 1, CAST({length} AS BIGINT))"""


_EVENT_COLUMNS = 'topic, "partition", consumerid, eventname, "second", operation, value, cnt'


def _event_json(names: dict[str, str]) -> str:
    def part(column: str) -> str:
        value = f"'\"' || {column} || '\"'" if column not in ('"second"', "value", "cnt") else column
        return f"'\"{names.get(column, column.strip(chr(34)))}\":' || {value}"

    columns = _EVENT_COLUMNS.split(", ")
    return "'{' || " + " || ',' || ".join(part(c) for c in columns) + " || '}'"


CHART_NAMES = {"consumerid": "consumerId", "eventname": "eventName", "cnt": "count"}

ORACLES: dict[str, str] = {
    # Topics and archive
    "topic_scan": f"""WITH {EV}
SELECT 'dropped' AS test_id, topic, part AS "partition", event_id AS "offset",
  CASE WHEN event_type = 'error' THEN chr(65533) || 'FF' || hex(encode(props)) ELSE payload END AS payload
FROM ev CROSS JOIN (VALUES ('src'), ('dst')) t(topic) WHERE NOT (topic = 'dst' AND event_id = 777)""",
    "topic_counts": f"WITH {MARKED} SELECT test_id, topic, count(*) AS total FROM marked GROUP BY ALL",
    "archive_counts": f"""WITH {MARKED}
SELECT test_id, topic, count(*) AS total FROM marked WHERE payload <> 'end-of-stream' GROUP BY ALL""",
    "end_markers": f"""WITH {MSG}
SELECT test_id, topic, "partition", 'end-of-stream' AS payload, count(*) AS messages_before FROM msg GROUP BY ALL""",
    "marker_filter": f"WITH {MARKED} SELECT * FROM marked WHERE payload <> 'end-of-stream'",
    "stream_progress": f"""WITH {MARKED}, expected AS (
  SELECT test_id, topic, CAST(p AS INTEGER) AS "partition" FROM runs CROSS JOIN range(4) AS r(p))
SELECT e.test_id, e.topic, e."partition", count(m.payload) AS markers, count(m.payload) > 0 AS done
FROM expected e LEFT JOIN marked m ON m.test_id = e.test_id AND m.topic = e.topic
  AND m."partition" = e."partition" AND m.payload = 'end-of-stream'
GROUP BY ALL""",
    "message_archive": f"""WITH {EV}
SELECT 'faithful' AS test_id, 'src' AS topic, CAST(user_id % 16 AS INTEGER) AS "partition", event_id AS "offset",
  CASE WHEN event_type = 'purchase' THEN payload || '#2' ELSE payload END AS payload
FROM ev""",
    "message_archive_rowkey": f"""WITH {MSG}, keyed AS (
  SELECT m.test_id || m.topic || (e.user_id % 16) || m."offset" AS id, m.test_id, m.topic,
         CAST(e.user_id % 16 AS INTEGER) AS "partition", m."offset", m.payload
  FROM msg m JOIN ev e ON e.event_id = m."offset")
SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY id ORDER BY "offset" DESC) = 1""",
    "row_keys": f"""WITH {MSG}
SELECT test_id, topic, "offset", test_id || topic || "partition" || "offset" AS joined_key,
  test_id || '/' || topic || '/' || lpad(CAST("partition" AS VARCHAR), 10, '0') || '/'
    || lpad(CAST("offset" AS VARCHAR), 20, '0') AS separated_key
FROM msg""",
    "test_lookup": """SELECT w.test_id, r.event_type AS source_topic, 'mirror_' || r.event_type AS destination_topic,
  CASE WHEN r.event_type IS NULL THEN 'NO_SUCH_TEST' ELSE 'FOUND' END AS status
FROM (VALUES ('purchase'), ('absent')) w(test_id)
LEFT JOIN (SELECT DISTINCT event_type FROM events) r ON r.event_type = w.test_id""",
    # Positions, digests, verdicts
    "message_positions": f"WITH {POS} SELECT * FROM pos",
    "message_positions_dense": f"""WITH {LINES}
SELECT 'lines' AS test_id, *, row_number() OVER (ORDER BY "partition", "offset") AS position FROM topic_lines""",
    "slice_digests": f"WITH {POS} {_digests('pos')}",
    "digest_tree": f"""WITH {MSG}
SELECT test_id, topic, "partition", CAST(level AS INTEGER) AS level, "offset" >> CAST(10 + 10 * level AS BIGINT) AS node, count(*) AS messages
FROM msg CROSS JOIN range(5) AS r(level) GROUP BY ALL""",
    "first_difference": f"""WITH {MSG},
differing AS (
  SELECT test_id, "partition", "offset", s.payload AS source_payload, d.payload AS destination_payload,
    CASE WHEN d.payload IS NULL THEN 'missing' WHEN s.payload IS NULL THEN 'extra' ELSE 'changed' END AS difference
  FROM (SELECT * FROM msg WHERE topic = 'src') s FULL JOIN (SELECT * FROM msg WHERE topic = 'dst') d USING (test_id, "partition", "offset")
  WHERE s.payload IS DISTINCT FROM d.payload)
SELECT test_id, "partition", "offset", difference, source_payload, destination_payload
FROM (SELECT DISTINCT test_id FROM runs) LEFT JOIN (
  SELECT * FROM differing QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY "partition", "offset") = 1) USING (test_id)""",
    "content_alignment": f"""WITH {POS},
bounds AS (
  SELECT *, sum(CASE WHEN CAST('0x' || substr(md5(payload), 1, 8) AS BIGINT) % 100 = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY test_id, topic ORDER BY position) AS slice FROM pos),
slices AS (
  SELECT *, row_number() OVER (PARTITION BY test_id, topic, digest ORDER BY slice) AS nth FROM (
    SELECT test_id, topic, slice, min(position) AS first, md5(string_agg(payload, chr(1) ORDER BY position)) AS digest
    FROM bounds GROUP BY ALL)),
met AS (
  SELECT test_id, s.slice AS a, s.first AS place, d.slice AS b
  FROM (SELECT * FROM slices WHERE topic = 'src') s FULL JOIN (SELECT * FROM slices WHERE topic = 'dst') d USING (test_id, digest, nth)),
seams AS (
  SELECT x.test_id, count(*) AS seams FROM met x JOIN met y ON y.test_id = x.test_id AND y.a = x.a + 1
  WHERE y.b <> x.b + 1 GROUP BY x.test_id)
SELECT test_id, count(a) AS source_slices, count(b) AS destination_slices, count(*) FILTER (WHERE b IS NULL) AS only_source,
  count(*) FILTER (WHERE a IS NULL) AS only_destination, coalesce(max(seams), 0) AS seams,
  min(place) FILTER (WHERE b IS NULL) AS first_lacking,
  count(a) = count(*) AND count(b) = count(*) AND max(seams) IS NULL AS aligned
FROM met LEFT JOIN seams USING (test_id) GROUP BY test_id""",
    "slice_digests_ordered": f"WITH {POS} {_digests('pos')}",
    "slice_digests_strict": f"WITH {POS} {_digests('pos', 'md5(payload)')}",
    "slice_digests_dense": f"""WITH {LINES}, pos AS (
  SELECT 'lines' AS test_id, *, row_number() OVER (ORDER BY "partition", "offset") AS position FROM topic_lines)
{_digests('pos')}""",
    "slice_digests_rowkey": f"""WITH {MSG}, pos AS (
  SELECT m.test_id, m.topic, m.payload, row_number() OVER (PARTITION BY m.test_id, m.topic
    ORDER BY (e.user_id % 16) || CAST(m."offset" AS VARCHAR), e.user_id % 16) AS position
  FROM msg m JOIN ev e ON e.event_id = m."offset")
{_digests('pos')}""",
    "slice_compare": f"WITH {_compared()} SELECT * FROM compared",
    "order_verdict": f"""WITH {_compared()}
SELECT test_id, bool_and(same) AS order_preserved, min(slice) FILTER (WHERE NOT same) AS first_difference
FROM compared GROUP BY test_id""",
    "count_verdict": f"""WITH {MSG}
SELECT test_id, count(*) FILTER (WHERE topic = 'src') AS source_total,
  count(*) FILTER (WHERE topic = 'dst') AS destination_total,
  count(*) FILTER (WHERE topic = 'src') = count(*) FILTER (WHERE topic = 'dst') AS same_amount
FROM msg GROUP BY test_id""",
    "validation_report": f"WITH {_report()} SELECT * FROM report UNION ALL {MISSING}",
    "validation_report_ordered": f"WITH {_report()} SELECT * FROM report UNION ALL {MISSING}",
    "validation_report_strict": f"WITH {_report('md5(payload)')} SELECT * FROM report",
    "validation_report_fingerprint": f"WITH {_report()} SELECT * FROM report UNION ALL {MISSING}",
    "validation_report_gapless": f"""WITH {LINES}, runs(test_id, topic) AS (
  VALUES ('lines', 'lines'), ('lines', 'copied'), ('edited', 'lines'), ('edited', 'copied')),
pos AS (
  SELECT test_id, CASE runs.topic WHEN 'lines' THEN 'src' ELSE 'dst' END AS topic,
         CASE WHEN test_id = 'edited' AND runs.topic = 'copied' AND "partition" = 1 AND "offset" = 2 THEN '!'
              ELSE payload END AS payload,
         row_number() OVER (PARTITION BY test_id, runs.topic ORDER BY "partition", "offset") AS position
  FROM topic_lines CROSS JOIN runs),
{_verdict()} SELECT * FROM report""",
    "verdict_lines": f"""WITH {_report()}
SELECT test_id, 0 AS line_no, '***** TEST RESULTS *****' AS line FROM report
UNION ALL SELECT test_id, 1, count_line FROM report
UNION ALL SELECT test_id, 2, order_line FROM report
UNION ALL SELECT 'absent', 0, 'There is no such test ''absent'''""",
    # Latencies
    "latency_scan": f"WITH {REC} SELECT * FROM rec WHERE arrived_us >= 1705320000000000",
    "tag_extract": f"""WITH {REC}
SELECT event_id, CASE WHEN topic <> 'signup' THEN topic END AS topic,
  CASE WHEN topic <> 'signup' THEN "partition" END AS "partition",
  CASE WHEN topic NOT IN ('signup', 'error') THEN consumerid END AS consumerid,
  CASE topic WHEN 'signup' THEN 'topic' WHEN 'error' THEN 'consumerId' END AS missing_tag
FROM rec""",
    "timing_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "timing_pairs_repeated": f"""WITH {PAIRS}
SELECT * FROM pairs WHERE topic <> 'error'
UNION ALL
SELECT topic, "partition", consumerid, 'created-created', 0, arrived_us FROM rec WHERE topic = 'view'
UNION ALL
SELECT topic, "partition", consumerid, 'created-created', 5, arrived_us FROM rec WHERE topic = 'click'
UNION ALL
SELECT topic, "partition", consumerid, 'consumed-created', created + 5 - consumed, arrived_us FROM rec WHERE topic = 'click'
UNION ALL
SELECT topic, "partition", consumerid, 'produced-created', created + 5 - produced, arrived_us FROM rec WHERE topic = 'click'""",
    "latency_buckets": f"WITH {BUCKETS} SELECT * FROM buckets",
    **{
        f"rolling_{n}{unit}": f"WITH {BUCKETS} {(_rolling if n * (unit == 'minute') <= 1 else _spans)(unit, n)}"
        for unit, n in WINDOWS
    },
    "rolling_all_windows": f"WITH {BUCKETS} " + " UNION ALL ".join(_spans(unit, n) for unit, n in WINDOWS),
    "rolling_10second_native": f"WITH {BUCKETS} {_rolling('second', 10)}",
    "latency_from_frames": f"""WITH {BUCKETS}, valid AS (SELECT * FROM buckets WHERE topic <> 'error')
{_rolling('second', 10, 'valid')}""",
    # Results
    "events_upsert": f"""WITH {RESULTS}
SELECT topic, "partition", consumerid, eventname, "second", operation,
  CASE WHEN topic = 'purchase' THEN value + 1 ELSE value END AS value, cnt FROM results""",
    "events_history": f"""WITH {RESULTS}
SELECT * FROM charted WHERE topic = 'click' AND "second" > 1705320000 - 3600""",
    "history_json": f"""WITH {RESULTS}
SELECT "second", "partition", consumerid, eventname, {_event_json(CHART_NAMES)} AS json
FROM charted WHERE topic = 'click' AND "second" > 1705320000 - 3600""",
    "live_feed": f"""WITH {RESULTS} SELECT * FROM charted WHERE "partition" <> '3'""",
    "event_json": f"""WITH {RESULTS}
SELECT topic, "second", "partition", consumerid, eventname, operation, {_event_json(CHART_NAMES)} AS json FROM results""",
    "result_topic_values": f"""WITH {RESULTS}
SELECT 'dataset-latencies' AS topic, {_event_json({})} AS json FROM results""",
    "series_long": f"""WITH {LONG} SELECT *, "second" * 1000000 AS time FROM long""",
    "series_points": _points('topic, consumerid, field, "partition", eventname'),
    "series_points_merged": _points('topic, consumerid, field, "partition"'),
    "series_extent": f"""WITH {LONG}
SELECT topic, consumerid, field, min("second") AS first_second, max("second") AS last_second,
  min(y) AS lowest, max(y) AS highest FROM long GROUP BY topic, consumerid, field""",
    # Records
    "wire_frame_split": f"""WITH {FRAMES}
SELECT event_id, CAST(schema_id AS BIGINT) AS schema_id, body, problem FROM split""",
    "wire_frame_build": """SELECT 'metrics' AS topic, '000000002A' || hex(encode(props)) AS value FROM events""",
    "record_decode": f"""WITH {FRAMES}
SELECT event_id, CASE schema_id WHEN 1 THEN 'counter' WHEN 2 THEN 'label' WHEN 3 THEN 'blob' END AS name,
  CASE WHEN schema_id = 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN schema_id = 2 THEN props END AS text, CASE WHEN schema_id = 3 THEN body END AS bytes,
  CASE WHEN problem IS NOT NULL THEN problem WHEN schema_id > 3 THEN 'unknown schema' END AS problem
FROM split""",
    "record_versions": f"""WITH {FRAMES}
SELECT event_id, CASE WHEN fits THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS n,
  CASE WHEN fits THEN 'things' END AS unit, CAST(NULL AS BIGINT) AS more,
  CASE WHEN problem IS NOT NULL THEN problem WHEN schema_id = 3 THEN 'n: string cannot become long'
    WHEN schema_id > 3 THEN 'unknown schema' END AS problem
FROM (SELECT *, problem IS NULL AND schema_id IN (1, 2) AS fits FROM split)""",
    "fallback_decode": f"""WITH {EV}
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'metric' WHEN 'signup' THEN 'marks'
    WHEN 'error' THEN NULL ELSE 'counter' END AS schema,
  CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END AS id,
  CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'created' END AS mark,
  CASE WHEN event_type IN ('purchase', 'signup') THEN t END AS marked_at
FROM ev""",
    "schema_catalog": """SELECT DISTINCT event_type AS origin,
  CASE WHEN event_type <> 'error' THEN event_type END AS name,
  CASE WHEN event_type <> 'error' THEN 'metrics' END AS namespace,
  CASE WHEN event_type <> 'error' THEN 'record' END AS kind,
  CASE WHEN event_type <> 'error' THEN 'id,k' END AS fields
FROM events""",
    # Datasets
    "lines_to_messages": f"WITH {LINES} SELECT * FROM topic_lines",
    "line_topic_values": f"""WITH {LINES}
SELECT 'dataset' AS topic, md5(line) AS value_md5, octet_length(encode(line)) AS n_bytes FROM ls""",
    "line_export": f"WITH {LINES} SELECT line || chr(10) AS line FROM ls",
    "replay": "SELECT event_id, props, CAST(r AS INTEGER) AS round FROM events CROSS JOIN range(3) AS x(r)",
    "synthetic_lines": f"""WITH {_synthetic(('relay', 10, 200))}
SELECT id, {_text('relay', 'id', 'n')} AS line FROM sized""",
    "size_bounded_lines": f"""WITH {_synthetic(('relay', 1024, 5000))}, before AS (
  SELECT id, n, coalesce(sum(n + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM sized)
SELECT id, n AS n_bytes, md5({_text('relay', 'id', 'n')}) AS line_md5 FROM before WHERE b < 10000000""",
    "dataset_topic": f"""WITH {_synthetic(('relay', 1024, 5000))}, before AS (
  SELECT id, n, coalesce(sum(n + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM sized)
SELECT 'dataset' AS topic, CAST(id % 4 AS INTEGER) AS "partition",
  row_number() OVER (PARTITION BY id % 4 ORDER BY id) - 1 AS "offset",
  md5({_text('relay', 'id', 'n')}) AS value_md5
FROM before WHERE b < 10000000""",
    "metric_records": f"""WITH {EV}
SELECT CAST(0 AS BIGINT) AS id, t // 1000 * 1000000 AS created, {_text('relay', 'event_id', '191')} AS value FROM ev""",
    # Streams
    "paced_replay": """WITH bounds AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events)
SELECT event_id, props, CAST((epoch_us(ts) - low) // ((high - low) // 4 + 1) AS BIGINT) AS slot FROM events CROSS JOIN bounds""",
    "report_feed": f"""WITH {RESULTS}
SELECT topic, "partition", consumerid, eventname, "second", operation, value, cnt, CAST(0 AS BIGINT) AS batch FROM results
UNION ALL SELECT topic, "partition", consumerid, eventname, "second", operation, value, cnt, 2 FROM results WHERE topic = 'purchase'""",
    "stream_message_archive": f"""WITH {EV}
SELECT 'faithful' AS test_id, 'src' AS topic, part AS "partition", event_id AS "offset", payload,
  (SELECT count(*) FROM ev) AS total
FROM ev WHERE event_type <> 'error'""",
    "stream_relay_check": f"WITH {_report()} SELECT *, true AS ended FROM report WHERE test_id = 'dropped'",
    "stream_latency_buckets": f"WITH {BUCKETS} SELECT * FROM buckets",
    "stream_rolling_10second": f"WITH {BUCKETS} {_rolling('second', 10)}",
    "stream_window_reports": f"""WITH {BUCKETS}
SELECT *, CAST(1 AS BIGINT) AS reports FROM ({_rolling('second', 10)} UNION ALL {_rolling('second', 30)})""",
    "events_levels": f"""WITH {RESULTS}
SELECT topic, "partition", consumerid, eventname, "second", operation,
  CASE WHEN topic = 'purchase' THEN value + 1 ELSE value END AS value, cnt FROM results""",
}
