"""Every operator as a query over the test tables, with the same in SQL."""

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import naming, throttle
from logweave.functions.codec import decode_chunk, encode_chunk
from logweave.operators import assemble, chunks, digest_tree, pump, segments, sequencing, tail
from logweave.plans.flow import rebuild
from logweave.plans.views import CONV, EVT, LINE, ONE, SESSION, conversations, events, orders, table
from logweave.sources import chunk_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ARRIVAL = ("arrival",)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def text(c: str = "payload"):
    return F.col(c).cast("string")


# -- rebuilding ------------------------------------------------------------------------------------------------------


@query(f"WITH {CONV} SELECT id || '.' || session AS name, md5(string_agg(payload, '' ORDER BY seq)) AS body_md5, count(*) AS chunks, max(seq) AS last_seq FROM conv GROUP BY id, session")
def reassemble_body(spark, sf_dir):
    flow = rebuild(conversations(spark, sf_dir))
    return flow.logs.select("name", F.md5("body").alias("body_md5"), "chunks", "last_seq")


PREFIX = f"""{ONE}, placed AS (SELECT *, seq - row_number() OVER w AS d, min(seq) OVER (PARTITION BY id, session) - 1 AS base FROM one WINDOW w AS (PARTITION BY id, session ORDER BY seq))"""


@query(f"WITH {PREFIX} SELECT id, md5(string_agg(payload, '' ORDER BY seq)) AS body_md5, max(seq) AS last_seq FROM placed WHERE d = base GROUP BY id")
def reassemble_gapped(spark, sf_dir):
    flow = rebuild(orders(spark, sf_dir), *ARRIVAL)
    return flow.logs.select("id", F.md5("body").alias("body_md5"), "last_seq")


@query(f"WITH {ONE} SELECT id, session, seq, payload FROM one")
def dedup_last_write(spark, sf_dir):
    return chunks.dedup_last_write(orders(spark, sf_dir), *ARRIVAL).select("id", "session", "seq", text().alias("payload"))


@query(f"WITH {LINE} SELECT id, session, seq, count(*) AS copies FROM line GROUP BY ALL HAVING count(*) > 1")
def dup_chunks(spark, sf_dir):
    return chunks.duplicates(orders(spark, sf_dir))


@query(f"WITH {PREFIX} SELECT id, session, seq, CASE WHEN d = base AND seq = base + 1 THEN 'init' WHEN d = base THEN 'append' ELSE 'gap' END AS decision FROM placed")
def seq_accept(spark, sf_dir):
    return rebuild(orders(spark, sf_dir), *ARRIVAL).decided.select("id", "session", "seq", "decision")


def _tracker(spark, sf_dir):
    """A made-up tracker: last = order number mod 3, none where that is 0."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().where("l_orderkey % 3 > 0")
    return keys.select(F.format_string("order_%d", "l_orderkey").alias("id"), F.lit(SESSION).cast("bigint").alias("session"), (F.col("l_orderkey") % 3).alias("last_seq"))


@query(
    f"""WITH {ONE}, known AS (SELECT *, l_orderkey % 3 AS last FROM one),
    fresh AS (SELECT *, seq - row_number() OVER (PARTITION BY id ORDER BY seq) AS d, CASE WHEN last = 0 THEN min(seq) OVER (PARTITION BY id) - 1 ELSE last END AS base FROM known WHERE seq > last)
    SELECT id, seq, last, 'stale' AS decision FROM known WHERE seq <= last
    UNION ALL SELECT id, seq, last, CASE WHEN d = base AND last = 0 AND seq = base + 1 THEN 'init' WHEN d = base THEN 'append' ELSE 'gap' END FROM fresh"""
)
def seq_accept_tracker(spark, sf_dir):
    return rebuild(orders(spark, sf_dir), *ARRIVAL, tracker=_tracker(spark, sf_dir)).decided.select("id", "seq", "last", "decision")


@query(f"WITH {LINE}, k AS (SELECT DISTINCT id, session, seq FROM line), g AS (SELECT *, lag(seq) OVER (PARTITION BY id, session ORDER BY seq) AS b FROM k) SELECT id, session, b + 1 AS first_missing, seq - 1 AS last_missing, seq - b - 1 AS missing FROM g WHERE seq - b > 1")
def seq_gaps(spark, sf_dir):
    return sequencing.gaps(orders(spark, sf_dir))


@query(f"WITH {PREFIX} SELECT id, session, max(seq) AS last_seq, id || '_' || session || '.lastSeq' AS file_name FROM placed WHERE d = base GROUP BY id, session")
def tracker_next(spark, sf_dir):
    return rebuild(orders(spark, sf_dir), *ARRIVAL).tracker


@query(f"WITH {CONV} SELECT id, session, max(seq) AS last_seq FROM conv GROUP BY ALL")
def tracker_load(spark, sf_dir):
    """Tracker files of all logs, written and read back."""
    from logweave.sources.files import write_tracker_files

    folder = f"{shared_folder(spark)}/tracker"
    write_tracker_files(rebuild(conversations(spark, sf_dir)).tracker, folder)
    return chunk_files.load_tracker(spark, folder)


@query(f"WITH {EVT} SELECT id, session, event_id, seq FROM evt")
def seq_assign(spark, sf_dir):
    return events(spark, sf_dir).select("id", "session", "event_id", "seq")


@query(f'WITH {CONV} SELECT id, seq, coalesce(sum(octet_length(encode(payload))) OVER (PARTITION BY id, session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", sum(octet_length(encode(payload))) OVER (PARTITION BY id, session ORDER BY seq)::BIGINT AS "end" FROM conv')
def byte_offsets(spark, sf_dir):
    return chunks.byte_offsets(conversations(spark, sf_dir)).select("id", "seq", "offset", "end")


@query(f"WITH {EVT} SELECT id, session, count(*) AS chunks, min(seq) AS first_seq, max(seq) AS last_seq FROM evt GROUP BY ALL")
def session_stats(spark, sf_dir):
    return chunks.session_ranks(events(spark, sf_dir)).drop("session_rank")


@query(f"WITH {EVT}, s AS (SELECT DISTINCT id, session FROM evt) SELECT id, session, dense_rank() OVER (PARTITION BY id ORDER BY session) AS session_rank FROM s")
def session_rank(spark, sf_dir):
    return chunks.session_ranks(events(spark, sf_dir)).select("id", "session", "session_rank")


# -- chunks, names, codec --------------------------------------------------------------------------------------------


@query('WITH d AS (SELECT doc_id, encode(text) AS b FROM documents), o AS (SELECT doc_id, b, unnest(range(0, octet_length(b), 4096)) AS pos FROM d) SELECT doc_id, pos AS "offset", least(4096, octet_length(b) - pos)::BIGINT AS size, md5(unhex(substr(hex(b), 2 * pos + 1, 8192))) AS piece_md5 FROM o')
def chunk_split_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))
    cut = chunks.split_fixed(docs, size=4096)
    return cut.select("doc_id", F.col("offset").cast("bigint").alias("offset"), F.octet_length("piece").cast("bigint").alias("size"), F.md5("piece").alias("piece_md5"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size, 'Name: ' || source || ' Session: 1 Seq: ' || doc_id || ' Payload: ' || octet_length(encode(text)) AS line FROM documents")
def chunk_sizes(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", size.cast("bigint").alias("size"), naming.describe_chunk(F.col("source"), F.lit(1), F.col("doc_id"), size).alias("line"))


@query(f"WITH {EVT} SELECT event_id, id || '_' || session || '_' || seq || '.pbData' AS name FROM evt")
def name_format(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", naming.chunk_file_name(F.col("id"), F.col("session"), F.col("seq")).alias("name"))


@query(f"WITH {EVT} SELECT event_id, id, session, seq FROM evt")
def name_parse(spark, sf_dir):
    df = name_format(spark, sf_dir).withColumn("path", F.concat(F.lit("/cache/"), "name"))
    return df.select("event_id", naming.parse_chunk_name(naming.base_name(F.col("path"))).alias("k")).select("event_id", "k.*")


def _odd_names(spark, sf_dir):
    url = naming.base_name(F.col("url"))
    name = F.when(F.col("page_id") % 3 == 0, F.concat(url, F.lit("_1_"), "page_id", F.lit(".pbData"))).when(F.col("page_id") % 3 == 1, F.concat(url, F.lit("__1.pbData"))).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


ODD = "odd AS (SELECT page_id, string_split(url, '/')[-1] AS base, CASE page_id % 3 WHEN 0 THEN string_split(url, '/')[-1] || '_1_' || page_id || '.pbData' WHEN 1 THEN string_split(url, '/')[-1] || '__1.pbData' ELSE string_split(url, '/')[-1] END AS name FROM pages)"


@query(f"WITH {ODD} SELECT page_id, name FROM odd WHERE NOT regexp_full_match(name, '(.*)_(\\d+)_(\\d+)\\.pbData')")
def name_quarantine(spark, sf_dir):
    return _odd_names(spark, sf_dir).where(naming.parse_chunk_name(F.col("name")).isNull())


@query(f"WITH {ODD} SELECT page_id, name FROM odd WHERE ends_with(name, '.pbData')")
def filter_suffix(spark, sf_dir):
    return _odd_names(spark, sf_dir).where(naming.is_chunk_name(F.col("name")))


@query(f"WITH {CONV} SELECT id, session, seq, md5(payload) AS payload_md5 FROM conv")
def codec_roundtrip(spark, sf_dir):
    df = conversations(spark, sf_dir).select(encode_chunk("id", "session", "seq", "payload").alias("content"))
    return df.select(decode_chunk("content").alias("b")).where("b.error is null").select("b.id", "b.session", "b.seq", F.md5("b.payload").alias("payload_md5"))


# -- sorting, queues, replies ----------------------------------------------------------------------------------------


@query(f"WITH {EVT} SELECT id, session, seq FROM evt")
def sort_chunks(spark, sf_dir):
    return events(spark, sf_dir).select("id", "session", "seq").orderBy("id", "session", "seq")


def _listing(spark, sf_dir):
    name = F.format_string("chunk_%d", "event_id")
    return table(spark, sf_dir, "events").select(name.alias("path"), F.when(F.col("event_id") % 11 > 0, F.col("ts")).alias("mtime"), "event_id", F.col("event_type").alias("id"))


LIST = "listing AS (SELECT 'chunk_' || event_id AS path, CASE WHEN event_id % 11 > 0 THEN ts END AS mtime, event_id, event_type AS id FROM events)"


@query(f"WITH {LIST} SELECT path, mtime FROM listing")
def sort_mtime(spark, sf_dir):
    return pump.oldest_first(_listing(spark, sf_dir)).select("path", "mtime")


@query(f"WITH {LIST} SELECT path, mtime FROM listing ORDER BY mtime NULLS LAST, path LIMIT 16")
def topk_oldest(spark, sf_dir):
    return pump.top_oldest(_listing(spark, sf_dir)).select("path", "mtime")


@query(f"WITH {LIST} SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY mtime NULLS LAST, path) AS place FROM listing QUALIFY place <= 16")
def topk_per_key(spark, sf_dir):
    return pump.top_oldest_per_key(_listing(spark, sf_dir), "id").select("id", "path", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {LIST}, q AS (SELECT * FROM listing ORDER BY mtime NULLS LAST, path LIMIT 16) SELECT path, ntile(5) OVER (ORDER BY mtime NULLS LAST, path) AS slot FROM q")
def push_slots(spark, sf_dir):
    return pump.slots(pump.top_oldest(_listing(spark, sf_dir))).select("path", F.col("slot").cast("bigint").alias("slot"))


@query(f"WITH {LIST} SELECT path, mtime FROM listing WHERE mtime IS NOT NULL AND event_id % 7 > 0 AND event_id % 13 > 0")
def push_candidates(spark, sf_dir):
    files = _listing(spark, sf_dir)
    return pump.candidates(files, files.where("event_id % 7 = 0"), files.where("event_id % 13 = 0")).select("path", "mtime")


def _replies(spark, sf_dir):
    body = F.when(F.col("event_id") % 4 == 0, "busy").when(F.col("event_id") % 4 == 1, F.concat(F.lit("Throttle: "), F.col("event_id") % 9, F.lit(" "))).when(F.col("event_id") % 4 == 2, "Throttle: soon").otherwise(throttle.reply(F.col("event_id") % 3))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("code"), body.alias("body"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"))


REPLY = "reply AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS code, CASE WHEN event_id % 4 = 1 THEN event_id % 9 WHEN event_id % 4 = 3 THEN event_id % 3 END::INTEGER AS throttle, epoch_ms(ts) AS now_ms FROM events)"


@query(f"WITH {REPLY} SELECT event_id, CASE WHEN code = 200 THEN 'delete' ELSE 'retry' END AS action, throttle FROM reply")
def push_outcome(spark, sf_dir):
    return pump.outcomes(_replies(spark, sf_dir)).select("event_id", "action", "throttle")


@query(f"WITH {REPLY} SELECT event_id, throttle, greatest(0, throttle::BIGINT * 1000 - 2500) AS rest_ms FROM reply WHERE throttle IS NOT NULL")
def throttle_parse(spark, sf_dir):
    df = _replies(spark, sf_dir).withColumn("throttle", throttle.parse_reply(F.col("body"))).where("throttle is not null")
    return df.select("event_id", "throttle", throttle.remaining_sleep(throttle.sleep_until(F.col("now_ms"), F.col("throttle")), F.col("now_ms") + 2500).alias("rest_ms"))


@query("SELECT event_id, 'Log server throttle = ' || coalesce(last_value(CASE WHEN event_id % 6 > 1 THEN event_id % 6 - 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS reply FROM events")
def throttle_setting(spark, sf_dir):
    """One control log a user; the command is -1 or 0 (read, or turn off is left out) or a number of seconds."""
    asked = F.when(F.col("event_id") % 6 > 1, F.col("event_id") % 6 - 1).otherwise(-1)
    commands = table(spark, sf_dir, "events").select("event_id", "user_id", asked.alias("seconds"))
    now = throttle.settings(commands, "seconds", "event_id", ["user_id"])
    return now.select("event_id", F.concat(F.lit("Log server throttle = "), "in_force").alias("reply"))


@query(f"WITH {EVT} SELECT event_id, 'Throttle: ' || (SELECT max(event_id) % 10 FROM events) AS reply FROM evt")
def ingest_reply(spark, sf_dir):
    control = table(spark, sf_dir, "events").agg((F.max("event_id") % 10).alias("seconds"))
    rows = table(spark, sf_dir, "events").select("event_id")
    return rows.crossJoin(F.broadcast(control)).select("event_id", throttle.reply(F.col("seconds")).alias("reply"))


@query("SELECT count(*) AS accepted, 'Count=' || count(*) AS reply FROM lineitem")
def ingest_count(spark, sf_dir):
    """Redeliveries count again: this is before de-duplication."""
    return orders(spark, sf_dir).agg(F.count("*").alias("accepted")).withColumn("reply", F.format_string("Count=%d", "accepted"))


# -- sets ------------------------------------------------------------------------------------------------------------


@query(f"WITH {LINE}, k AS (SELECT id, session, seq, max(payload) AS p FROM line GROUP BY ALL) SELECT id, session, string_agg(seq || '=' || p, ',' ORDER BY seq) AS chunks FROM k GROUP BY ALL")
def nested_group(spark, sf_dir):
    return chunks.joined_values(orders(spark, sf_dir).withColumn("payload", text()), "payload")


@query(f"WITH {ONE}, a AS (SELECT * FROM one WHERE l_orderkey % 3 < 2), b AS (SELECT * FROM one WHERE l_orderkey % 3 > 0) SELECT coalesce(a.id, b.id) AS id, coalesce(a.seq, b.seq) AS seq, CASE WHEN b.id IS NOT NULL THEN 'b:' || b.payload ELSE 'a:' || a.payload END AS payload, a.id IS NOT NULL AND b.id IS NOT NULL AS in_both FROM a FULL JOIN b ON a.id = b.id AND a.seq = b.seq")
def merge_chunk_sets(spark, sf_dir):
    rows = orders(spark, sf_dir)
    a = rows.where("l_orderkey % 3 < 2").withColumn("payload", F.concat(F.lit("a:"), text()))
    b = rows.where("l_orderkey % 3 > 0").withColumn("payload", F.concat(F.lit("b:"), text()))
    return chunks.merge_sets(a, b, "payload", *ARRIVAL).select("id", "seq", "payload", "in_both")


@query(f"WITH {EVT} SELECT id, session, (seq // 256)::BIGINT AS part, count(*)::INTEGER AS entries, md5(string_agg(event_id, ',' ORDER BY seq)) AS values_md5 FROM evt GROUP BY ALL")
def segment_map(spark, sf_dir):
    """The nested map of logs as sorted segments; a session is as many rows as it has ranges of 256 numbers."""
    held = segments.segments_of(events(spark, sf_dir), "event_id")
    return held.select("id", "session", "part", F.size("at").alias("entries"), F.md5(F.array_join(F.col("values").cast("array<string>"), ",")).alias("values_md5"))


@query(f"WITH {EVT}, l AS (SELECT *, seq % 3 AS r FROM evt) SELECT id, session, seq, CASE WHEN r = 0 THEN 'c' WHEN r = 1 THEN 'b' ELSE 'a' END || event_id AS value, r < 2 AS shared FROM l")
def segment_merge(spark, sf_dir):
    """Three maps merged at once: all numbers, those with seq mod 3 under 2, and those with 0; the last map that has a number gives its value."""
    rows = events(spark, sf_dir)
    named = lambda which, name: segments.segments_of(rows.where(which).withColumn("value", F.concat(F.lit(name), F.col("event_id").cast("string"))), "value")
    return segments.entries(segments.merge(named("true", "a"), named("seq % 3 < 2", "b"), named("seq % 3 = 0", "c")), "value")


@query(f"WITH {EVT}, w AS (SELECT id, session, seq + 1 AS seq FROM evt WHERE event_id % 3 = 0) SELECT w.id, w.session, w.seq, event_id, event_id IS NOT NULL AS found FROM w LEFT JOIN evt USING (id, session, seq)")
def segment_lookup(spark, sf_dir):
    """The events that follow every third one in its log, found through segments; the number after a log's last is not there."""
    rows = events(spark, sf_dir)
    wanted = rows.where("event_id % 3 = 0").select("id", "session", (F.col("seq") + 1).alias("seq"))
    return segments.lookup(segments.segments_of(rows, "event_id"), wanted, "event_id")


@query(f"WITH {CONV}, {EVT} SELECT id, session, seq, payload FROM conv UNION ALL SELECT id, session, seq, payload FROM evt")
def union_sources(spark, sf_dir):
    keep = ["id", "session", "seq", text().alias("payload")]
    return conversations(spark, sf_dir).select(*keep).unionByName(events(spark, sf_dir).select(*keep))


@query(f"WITH {CONV}, a AS (SELECT id, unnest(string_split(payload, chr(10))) AS line FROM conv), b AS (SELECT id, unnest(string_split(payload, chr(10))) AS line FROM conv WHERE seq <> 2), x AS (SELECT id, line, 1 AS n FROM a UNION ALL SELECT id, line, -1 FROM b) SELECT id, line, abs(sum(n))::BIGINT AS surplus, CASE WHEN sum(n) > 0 THEN 'source' ELSE 'rebuilt' END AS side FROM x GROUP BY id, line HAVING sum(n) <> 0")
def diff_source_rebuilt(spark, sf_dir):
    """With every second chunk left out of the rebuilt side, so that there is a difference."""
    a = conversations(spark, sf_dir)
    split = lambda df: df.select("id", F.explode(F.split(text(), "\n")).alias("line"))
    return assemble.difference(split(a), split(a.where("seq <> 2"))).select("id", "line", "surplus", "side")


SWAPPED = f"""{CONV}, l AS (SELECT id, session, string_split(string_agg(payload, chr(10) ORDER BY seq), chr(10)) AS a, string_split(string_agg(payload, chr(10) ORDER BY CASE seq WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE seq END), chr(10)) AS b FROM conv GROUP BY ALL),
a AS (SELECT id, session, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM l), b AS (SELECT id, session, unnest(b) AS line, generate_subscripts(b, 1) - 1 AS line_no FROM l WHERE length(id) % 2 = 0 OR ends_with(id, '1'))"""


def _swapped(spark, sf_dir):
    """Lines of logs, and of the same logs with chunks 2 and 3 in each other's place, of which some are missing."""
    ended = conversations(spark, sf_dir).withColumn("payload", F.concat("payload", F.lit(b"\n")))
    wrong = ended.withColumn("seq", F.when(F.col("seq") == 2, 3).when(F.col("seq") == 3, 2).otherwise(F.col("seq")))
    split = lambda df: assemble.lines(assemble.bodies(df).withColumn("body", F.substring("body", F.lit(1), F.octet_length("body") - 1)))
    return split(ended), split(wrong.where(F.expr("length(id) % 2 = 0 or id like '%1'")))


@query(f"WITH {SWAPPED} SELECT id, session, line_no, a.line AS source, b.line AS rebuilt, CASE WHEN b.line IS NULL THEN 'source' WHEN a.line IS NULL THEN 'rebuilt' ELSE 'changed' END AS side FROM a FULL JOIN b USING (id, session, line_no) WHERE a.line IS DISTINCT FROM b.line")
def diff_positions(spark, sf_dir):
    """Lines that have changed places are found, with the places."""
    a, b = _swapped(spark, sf_dir)
    out = digest_tree.differences(a, b, ["id", "session"], "line_no", "line", leaf=4, fanout=4)
    return out.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(f"WITH {SWAPPED}, x AS (SELECT id, session, list(line ORDER BY line_no) AS s FROM a GROUP BY ALL), y AS (SELECT id, session, list(line ORDER BY line_no) AS s FROM b GROUP BY ALL) SELECT id, session, coalesce(x.s = y.s, false) AS equal FROM x FULL JOIN y USING (id, session)")
def logs_equal(spark, sf_dir):
    a, b = _swapped(spark, sf_dir)
    return digest_tree.equal(a, b, ["id", "session"], "line_no", "line")


@query(f"WITH {CONV} SELECT id, session, sum(len(string_split(payload, chr(10))))::BIGINT AS n_lines, max(seq) AS counter, (sum(len(string_split(payload, chr(10)))) - max(seq))::BIGINT AS delta FROM conv GROUP BY ALL")
def logcheck(spark, sf_dir):
    """Each chunk ends its last line with its number; blank lines get a mark so that they count."""
    marked = conversations(spark, sf_dir).withColumn("payload", F.encode(F.concat(F.regexp_replace(text(), r"(?m)^\s*$", "-"), F.lit(" "), F.col("seq"), F.lit("\n")), "utf-8"))
    return assemble.check_counter(assemble.lines(assemble.bodies(marked)))


@query("SELECT n, '<' || strftime(TIMESTAMP '2024-01-01' + to_milliseconds(8 * n), '%A %B %d, %Y %H:%M:%S.%f') || '> Hello, World! ' || n AS line FROM (SELECT unnest(range(1, count(*) + 1)) AS n FROM events)")
def loggen_lines(spark, sf_dir):
    return chunk_files.generated_lines(spark, table(spark, sf_dir, "events").count())


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS n, r_name AS path FROM region")
def config_split_paths(spark, sf_dir):
    """The regions' names, of which there are five, as a setting."""
    names = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return spark.createDataFrame(list(enumerate(chunk_files.split_paths(" , ".join(names) + ","))), "n bigint, path string")


@query("SELECT event_id, '/logs/' || user_id || '/' || event_type AS path FROM events")
def path_normal(spark, sf_dir):
    step = F.when(F.col("event_id") % 2 == 0, "/./x/..//").otherwise("/a/../")
    return table(spark, sf_dir, "events").select("event_id", naming.normal_path(F.concat(F.lit("/../logs/./"), "user_id", step, "event_type", F.lit("/"))).alias("path"))


# -- tailing ---------------------------------------------------------------------------------------------------------


def _snapshots(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select(F.concat(F.lit("log_"), "user_id").alias("path"), F.col("event_id").alias("poll"), (F.col("event_id") % 17 > 0).alias("exists"), F.when(F.col("event_id") % 17 > 0, F.floor(F.col("event_id") / 2500).cast("string")).alias("inode"), F.when(F.col("event_id") % 17 > 0, F.col("event_id") % 5).alias("size"))


SNAP = """snap AS (SELECT 'log_' || user_id AS path, event_id AS poll, event_id % 17 > 0 AS there, CASE WHEN event_id % 17 > 0 THEN (event_id // 2500)::VARCHAR END AS inode, CASE WHEN event_id % 17 > 0 THEN event_id % 5 END AS size FROM events),
known AS (SELECT *, last_value(inode IGNORE NULLS) OVER w AS known_inode, coalesce(last_value(size IGNORE NULLS) OVER w, 0) AS total_read FROM snap WINDOW w AS (PARTITION BY path ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {SNAP} SELECT path, poll, CASE WHEN NOT there THEN 'DELETED' WHEN known_inode <> inode THEN 'MOVED' WHEN size > total_read THEN 'NEWDATA' WHEN size = total_read THEN 'UNCHANGED' ELSE 'TRUNCATED' END AS status FROM known")
def tail_status(spark, sf_dir):
    return tail.classify(_snapshots(spark, sf_dir)).select("path", "poll", "status")


@query("SELECT event_id, user_id, event_id % 5 - 1 AS nread FROM events WHERE event_id % 5 > 1")
def tail_poll_chunks(spark, sf_dir):
    polls = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 5 - 1).alias("nread"))
    return tail.polls_with_data(polls)


@query("SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events")
def poll_timestamp(spark, sf_dir):
    return tail.stamped(table(spark, sf_dir, "events").select("event_id", "ts"), F.col("ts").cast("timestamp")).select("event_id", "ts_ms")


@query(f"WITH {LIST} SELECT count(*) AS in_flight FROM listing WHERE event_id % 5 < 2 OR event_id % 3 = 0")
def in_flight(spark, sf_dir):
    files = _listing(spark, sf_dir)
    return pump.in_flight(files.where("event_id % 5 < 2"), files.where("event_id % 3 = 0"))


@query(f"WITH {LIST} SELECT path FROM listing WHERE event_id % 4 = 0 AND event_id % 3 > 0")
def push_present(spark, sf_dir):
    files = _listing(spark, sf_dir)
    return pump.present(files.where("event_id % 4 = 0"), files.where("event_id % 3 > 0")).select("path")


@query("SELECT user_id, count(*) AS polls, NOT bool_or(event_id % 5 - 1 > 0) AS idle FROM events GROUP BY user_id")
def poll_idle(spark, sf_dir):
    polls = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5 - 1).alias("nread"))
    return tail.idle(polls, "user_id")


# -- files and streams: written to a folder first, so the runs below need one that all executors share ---------------


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder's name under spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return tempfile.mkdtemp(prefix="logweave-")
    return f"{base.removeprefix('file://')}/logweave-{uuid.uuid4().hex}"


def _chunk_folder(spark, sf_dir) -> str:
    from logweave.sources.files import write_chunk_files

    folder = f"{shared_folder(spark)}/cache"
    write_chunk_files(conversations(spark, sf_dir), folder)
    return folder


@query(f"WITH {CONV} SELECT id, session, seq, md5(payload) AS payload_md5, true AS same_key FROM conv")
def scan_binaryfile(spark, sf_dir):
    df = chunk_files.read_chunks(spark, _chunk_folder(spark, sf_dir))
    return df.select("id", "session", "seq", F.md5("payload").alias("payload_md5"), "same_key")


@query(f"WITH {CONV} SELECT id || '_' || session || '_' || seq || '.pbData' AS name, id, session, seq, true AS ok FROM conv")
def scan_listing(spark, sf_dir):
    return chunk_files.list_chunks(spark, _chunk_folder(spark, sf_dir)).select("name", "id", "session", "seq", "ok")


@query(f"WITH {CONV} SELECT id, session, seq, CASE WHEN seq % 2 = 1 THEN md5(payload) ELSE md5(payload || '!') END AS payload_md5, 0::BIGINT AS seen_before FROM conv")
def write_recovered(spark, sf_dir):
    """Two jobs that are lost between commit and publication, of which the second replaces the even chunks: the next publication finishes both, in order."""
    from logweave.sources.files import chunk_rows, publish, stage

    folder, rows = f"{shared_folder(spark)}/cache", conversations(spark, sf_dir)
    stage(chunk_rows(rows), folder)
    stage(chunk_rows(rows.where("seq % 2 = 0").withColumn("payload", F.concat("payload", F.encode(F.lit("!"), "utf-8")))), folder)
    before = chunk_files.read_chunks(spark, folder).count()
    publish(spark, folder)
    return chunk_files.read_chunks(spark, folder).select("id", "session", "seq", F.md5("payload").alias("payload_md5"), F.lit(before).cast("bigint").alias("seen_before"))


def _receiver(path: str, body: bytes) -> tuple[int, str]:
    """Refuses chunk files whose number ends in 3."""
    return (503, "Throttle: 5") if path.endswith("3.pbData") else (200, "Throttle: 0")


@query(f"WITH {CONV} SELECT id || '_' || session || '_' || seq || '.pbData' AS name, CASE WHEN seq % 10 = 3 THEN 2 ELSE 1 END AS attempts, CASE WHEN seq % 10 = 3 THEN 503 ELSE 200 END AS code, CASE WHEN seq % 10 = 3 THEN 'retry' ELSE 'delete' END AS action, seq % 10 = 3 AS still_there FROM conv")
def delivery_rounds(spark, sf_dir):
    """Chunk files pushed in three rounds by drivers that were lost before they deleted: the second has nothing due, the third tries again what was refused; then the sweep."""
    from logweave.streaming.delivery import Deliveries

    base = shared_folder(spark)
    folder = _chunk_folder(spark, sf_dir)
    start = datetime(2024, 1, 1)
    for seconds in (0, 4, 5):
        Deliveries(spark, f"{base}/deliveries").send(chunk_files.list_chunks(spark, folder), folder, _receiver, start + timedelta(seconds=seconds))
    done = Deliveries(spark, f"{base}/deliveries")
    done.sweep(chunk_files.list_chunks(spark, folder))
    left = chunk_files.list_chunks(spark, folder).select("path", F.lit(True).alias("_there"))
    name = naming.base_name(F.col("path"))
    return done.states().join(left, "path", "left").select(name.alias("name"), "attempts", "code", "action", F.coalesce("_there", F.lit(False)).alias("still_there"))


def _streamed(spark, sf_dir) -> DataFrame:
    from logweave.streaming.reassemble import run_available, sequenced

    base = shared_folder(spark)
    rows = conversations(spark, sf_dir)
    rows.where("seq % 2 = 0").write.parquet(f"{base}/in")
    stream = lambda: sequenced(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    run_available(spark, stream(), f"{base}/out", f"{base}/state")
    rows.where("seq % 2 = 1 or seq = 2").write.mode("append").parquet(f"{base}/in")
    run_available(spark, stream(), f"{base}/out", f"{base}/state")
    rows.where("seq = 1").write.mode("append").parquet(f"{base}/in")
    run_available(spark, stream(), f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    shutil.rmtree(f"{base}/state", ignore_errors=True)
    return out


@query(f"WITH {CONV} SELECT id || '.' || session AS name, md5(string_agg(payload, '' ORDER BY seq)) AS body_md5, count(*) AS chunks FROM conv GROUP BY id, session")
def stream_reassemble(spark, sf_dir):
    """Even chunks first, then the odd ones and chunk 2 again, then chunk 1 again, in three runs of one checkpointed stream."""
    taken = _streamed(spark, sf_dir).where("decision = 'append'").select("id", "session", "seq", "payload")
    return assemble.bodies(taken).select("name", F.md5("body").alias("body_md5"), "chunks")


@query(f"WITH {CONV} SELECT id, session, seq FROM conv WHERE seq = 1")
def stream_stale(spark, sf_dir):
    """Chunk 2 came again while it waited for chunk 1 and replaced the waiting copy; chunk 1 came again after it was appended."""
    return _streamed(spark, sf_dir).where("decision = 'stale'").select("id", "session", "seq")


@query(f"WITH {CONV}, m AS (SELECT id, session, max(seq) AS m FROM conv GROUP BY ALL) SELECT conv.id, conv.session, least(m, 3) AS last_seq, sum(octet_length(encode(payload))) FILTER (seq <= 3)::BIGINT AS bytes, count(*) FILTER (seq >= 5)::BIGINT AS waiting FROM conv JOIN m USING (id, session) GROUP BY conv.id, conv.session, m")
def state_tracker(spark, sf_dir):
    """The tracker and what waits, read from the state of a stream that has had two runs, of which the second went on from the first's state with another number of partitions; no chunk 4 comes."""
    from logweave.streaming.reassemble import carried, run_available, sequenced, tracker_of, waiting_of

    base, rows = shared_folder(spark), conversations(spark, sf_dir)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for k, which in enumerate(("seq in (1, 3) or seq >= 6", "seq in (2, 5) or seq = 1")):
        rows.where(which).write.parquet(f"{base}/in{k}")
        initial = carried(spark, f"{base}/state0") if k else None
        try:
            spark.conf.set("spark.sql.shuffle.partitions", str(int(was) + k))
            run_available(spark, sequenced(spark.readStream.schema(rows.schema).parquet(f"{base}/in{k}"), initial=initial), f"{base}/out{k}", f"{base}/state{k}")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
    waits = waiting_of(spark, f"{base}/state1").groupBy("id", "session").agg(F.count("*").alias("waiting"))
    return tracker_of(spark, f"{base}/state1").join(waits, ["id", "session"], "left").withColumn("waiting", F.coalesce("waiting", F.lit(0).cast("bigint")))


@query(f"WITH {CONV} SELECT id, session, 2::BIGINT AS first_missing, 3::BIGINT AS last_missing FROM conv GROUP BY ALL HAVING max(seq) >= 4")
def stream_expired(spark, sf_dir):
    """Gaps that chunks have waited behind for longer than a millisecond, reported by timers, each once: chunks 2 and 3 never come."""
    from logweave.streaming.reassemble import run_available, sequenced

    base, rows = shared_folder(spark), conversations(spark, sf_dir)
    for which in ("seq = 1 or seq >= 4", "seq = 1"):
        rows.where(which).write.mode("append").parquet(f"{base}/in")
        run_available(spark, sequenced(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), patience_ms=1), f"{base}/out", f"{base}/state")
    found = spark.read.parquet(f"{base}/out").where("decision = 'expired'")
    return found.select("id", "session", F.col("seq").alias("first_missing"), F.col("upto").alias("last_missing"))


def _stored(spark, sf_dir):
    """A log store after three runs of one stream, of which two went on from the checkpoint: chunks 1 and 2, then from 4 on and 2 again, then 3 and 1 again."""
    from logweave.streaming.logstore import LogStore
    from logweave.streaming.reassemble import sequenced

    base = shared_folder(spark)
    store, rows = LogStore(spark, f"{base}/store"), conversations(spark, sf_dir)
    for which in ("seq <= 2", "seq >= 4 or seq = 2", "seq in (1, 3)"):
        rows.where(which).write.mode("append").parquet(f"{base}/in")
        store.consume(sequenced(spark.readStream.schema(rows.schema).parquet(f"{base}/in")), f"{base}/state")
    return store


@query(f"WITH {CONV} SELECT id || '.' || session AS name, md5(string_agg(payload, '' ORDER BY seq)) AS body_md5, count(*) AS chunks, sum(octet_length(encode(payload)))::BIGINT AS bytes, true AS whole FROM conv GROUP BY id, session")
def store_rebuild(spark, sf_dir):
    store = _stored(spark, sf_dir)
    both = assemble.bodies(store.chunks()).join(store.extents().drop("chunks"), ["id", "session"])
    return both.select("name", F.md5("body").alias("body_md5"), "chunks", "bytes", "whole")


@query(f"WITH {CONV}, r AS (SELECT unnest([0, 1, 2])::BIGINT AS batch) SELECT batch, count(seq) AS chunks, coalesce(sum(octet_length(encode(payload))), 0)::BIGINT AS bytes FROM r LEFT JOIN conv ON batch = CASE WHEN seq <= 2 THEN 0 ELSE 2 END GROUP BY batch")
def store_ledger(spark, sf_dir):
    """Each run's bytes are the new ones: what waits behind chunk 3 in the second run comes with the third."""
    return _stored(spark, sf_dir).ledger()


@query(f"WITH {CONV}, b AS (SELECT id, session, hex(encode(string_agg(payload, '' ORDER BY seq))) AS h FROM conv GROUP BY ALL), p AS (SELECT *, unnest(range(0, length(h) // 2, 1000)) AS pos FROM b) SELECT id, session, pos // 1000 AS part, md5(unhex(substr(h, 2 * pos + 1, 2000))) AS slice_md5 FROM p")
def store_slices(spark, sf_dir):
    """Logs in rows of 1,000 bytes, for logs that are larger than a row can be."""
    return _stored(spark, sf_dir).slices(1000).select("id", "session", "part", F.md5("data").alias("slice_md5"))


@query(f"WITH {CONV} SELECT id || '.' || session AS id, md5(string_agg(payload, '' ORDER BY seq)) AS body_md5, sum(octet_length(encode(payload)))::BIGINT AS bytes FROM conv GROUP BY id, session HAVING sum(octet_length(encode(payload))) > 0")
def tail_stream(spark, sf_dir):
    """Files that grow and are rotated, tailed by a running stream in two runs: what it has read is what was written, each byte once."""
    from logweave.sources.files import write_logs
    from logweave.sources.tail_source import register
    from logweave.streaming.reassemble import run_available

    base, rows = shared_folder(spark), conversations(spark, sf_dir)
    logs = lambda which: write_logs(assemble.bodies(rows.where(which)), f"{base}/logs")
    logs("seq <= 2")
    paths = sorted(f"{base}/logs/{name}" for name in os.listdir(f"{base}/logs") if not name.startswith("_"))
    register(spark)

    def run():
        stream = spark.readStream.format("logtail").option("paths", ",".join(paths)).option("session", "1").option("startingOffsets", "earliest").load()
        run_available(spark, stream, f"{base}/out", f"{base}/state")

    run()
    for path in paths:
        os.rename(path, f"{path}.1")
    logs("seq > 2")
    run()
    read = chunks.byte_offsets(spark.read.parquet(f"{base}/out"))
    return assemble.bodies(read).select("id", F.md5("body").alias("body_md5"), F.octet_length("body").cast("bigint").alias("bytes"))


@query(f"WITH {CONV} SELECT id, session, seq, CASE WHEN seq % 2 = 1 THEN 'first' ELSE 'second' END AS run FROM conv")
def stream_files(spark, sf_dir):
    """Chunk files through the file stream: each run takes the files that are new, once."""
    from logweave.sources.files import write_chunk_files
    from logweave.streaming.reassemble import chunk_file_stream, run_available

    base, rows = shared_folder(spark), conversations(spark, sf_dir)
    for name, which in (("first", "seq % 2 = 1"), ("second", "seq % 2 = 0")):
        write_chunk_files(rows.where(which), f"{base}/cache")
        stream = chunk_file_stream(spark, f"{base}/cache", 1000, listing=f"{base}/listing").withColumn("run", F.lit(name))
        run_available(spark, stream, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("id", "session", "seq", "run")
