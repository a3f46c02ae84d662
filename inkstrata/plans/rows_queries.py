"""Queries with sequential, native or streaming parts; most have no SQL to check them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.operators import adapters, locate
from inkstrata.plans.field_queries import FIELDS, assessed, each_field
from inkstrata.plans.registry import load, query
from inkstrata.plans.workflow import compile_workflow
from inkstrata.sources.html import text_of
from inkstrata.streaming import ingest


def _phrases(spark: SparkSession, sf_dir: str) -> list[str]:
    """The texts of the benchmark, whole; a benchmark is a bounded list, of which more than ``MOST_PHRASES`` is an error, not a cut."""
    texts = sorted({r.text for r in load(spark, sf_dir, "benchmark").where("trim(text) <> ''").select("text").limit(MOST_PHRASES + 1).toLocalIterator()})
    if len(texts) > MOST_PHRASES:
        raise ValueError(f"a benchmark of over {MOST_PHRASES} items is sought in parts")
    return texts


#: Phrases that one plan may hold.
MOST_PHRASES = 20_000


@query("locate_exact", f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM documents),
n AS (SELECT doc_id, list_filter(list_transform(ws, lambda w: translate(lower(w), '$€£¥,', '')), lambda w: w <> '') AS ns FROM d), j AS (SELECT doc_id, array_to_string(ns, ' ') AS joined FROM n),
q AS (SELECT DISTINCT text AS query, array_to_string(list_filter(string_split_regex(translate(lower(text), '$€£¥,', ''), '\\s+'), lambda w: w <> ''), ' ') AS want FROM benchmark WHERE trim(text) <> ''),
h AS (SELECT doc_id, query, want, joined, instr(joined, want) AS ofs FROM j JOIN q ON contains(joined, want))
SELECT doc_id, query, CAST(length(substring(joined, 1, ofs - 1)) - length(replace(substring(joined, 1, ofs - 1), ' ', '')) AS INTEGER) AS first_word, CAST(length(substring(joined, 1, ofs - 1)) - length(replace(substring(joined, 1, ofs - 1), ' ', '')) + length(want) - length(replace(want, ' ', '')) AS INTEGER) AS last_word FROM h""")
def locate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first exact place of every whole benchmark text in every document, as numbers of words."""
    found = locate.everywhere(load(spark, sf_dir, "documents").select("doc_id", "text"), _phrases(spark, sf_dir), fuzzy=False)
    return found.select("doc_id", "query", "first_word", "last_word")


@query("locate_spans")
def locate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every e-mail address and network address of every document, misread in its first letter, sought in that document: near places."""
    rows = each_field(load(spark, sf_dir, "documents")).where("field in ('email', 'address')").select("doc_id", F.regexp_replace("a.value", "^.", "#").alias("query")).where("query is not null")
    found = locate.spans(load(spark, sf_dir, "documents").select("doc_id", "text"), rows)
    return found.select("doc_id", "query", "exact", "ratio", "first_word", "last_word", "page", "found")


@query("evidence_attach")
def evidence_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the fields of every document; text and fields travel in one row, so nothing is joined."""
    rows = assessed(load(spark, sf_dir, "documents")).select("doc_id", "text", F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["a"]["value"].alias("value"))).alias("fields"))
    return locate.evidence_of(rows).select("doc_id", "field", "value", "source", F.col("ratio").alias("confidence"), "page", "found")


@query("dictionary_scan", """WITH o AS (SELECT doc_id, regexp_extract_all(text, 'Apache License|General Public License|MIT License|MIT') AS m, string_split_regex(text, 'Apache License|General Public License|MIT License|MIT') AS p FROM documents),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM o) SELECT doc_id, CASE WHEN starts_with(m[i], 'A') THEN 'APACHE' WHEN starts_with(m[i], 'G') THEN 'GPL' ELSE 'MIT' END AS entity, CAST(length(array_to_string(p[1:i], '')) + coalesce(length(array_to_string(m[1:i-1], '')), 0) AS INTEGER) AS begin, m[i] AS value FROM x""")
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = {"Apache License": "APACHE", "General Public License": "GPL", "MIT License": "MIT", "MIT": "MIT"}
    return locate.dictionary(load(spark, sf_dir, "documents"), terms).select("doc_id", "entity", "begin", "value")


@query("html_text_parse")
def html_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.length(text).alias("chars"), F.md5(text).alias("text_md5"), F.size(F.split(text, "\n")).alias("lines"))


def fake_model():
    """A stand-in for a model: the fields that patterns find, as JSON."""
    import json
    import re

    compiled = {n: re.compile(p) for n, p in FIELDS.items()}
    return lambda texts: [json.dumps({n: m.group() if (m := p.search(t or "")) else None for n, p in compiled.items()}, ensure_ascii=False) for t in texts]


_JSON = "regexp_extract(text, '{0}', 0)"


@query("adapter_multi_extract", "SELECT doc_id, " + ", ".join(f"nullif({_JSON.format(p)}, '') AS {n}" for n, p in FIELDS.items()) + ", CAST(3 AS INTEGER) AS instances, CAST(0 AS BIGINT) AS failed FROM documents")
def adapter_multi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = adapters.candidates(load(spark, sf_dir, "documents").select("doc_id", "text"), fake_model, 3)
    parsed = F.from_json(F.try_element_at("outputs", F.lit(1)), ", ".join(f"{n} string" for n in FIELDS))
    return answers.select("doc_id", parsed.alias("f"), F.size("outputs").alias("instances"), "failed").select("doc_id", "f.*", "instances", "failed")


@query("workflow_run", """WITH x AS (SELECT lang, nullif(regexp_extract(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+[A-Za-z]', 0), '') AS email, nullif(regexp_extract(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', 0), '') AS address FROM documents WHERE n_chars > 100)
SELECT lang, count(*) AS documents, count(*) FILTER (WHERE email IS NULL OR address IS NULL) AS needs_review, count(*) FILTER (WHERE email IS NULL AND address IS NULL) AS both_missing FROM x GROUP BY lang""")
def workflow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured workflow: filter, extraction, review."""
    flow = compile_workflow({"name": "contacts", "steps": [
        {"step": "keep", "where": "n_chars > 100"}, {"step": "extract", "fields": {"email": FIELDS["email"], "address": FIELDS["address"]}}, {"step": "review", "required": ["email", "address"]},
    ]})
    out = flow(load(spark, sf_dir, "documents"))
    return out.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("needs_review").alias("needs_review"), F.count_if(F.array_contains("reasons", "missing: email, address")).alias("both_missing"))


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints that all executors share, or a temporary one in local mode."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="inkstrata-stream-")
    return f"{where}/stream-{uuid.uuid4().hex}"


@query("stream_ingest", "SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE length(text) > 0 GROUP BY lang")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ingested by a stream, each file once, then summed."""
    base = _folder(spark)
    rows = ingest.documents(spark, f"{sf_dir}/documents.parquet").where(F.length("text") > 0).select("doc_id", "lang", "n_chars")
    ingest.run_once(rows, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("stream_quality_trend", """WITH s AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS begin, event_type, count(*) AS events, CAST(count(value) AS HUGEINT) AS n, CAST(sum(CAST(value AS DECIMAL(38,12))) * 1000000000000 AS HUGEINT) AS total FROM events GROUP BY ALL)
SELECT begin, event_type, events, ((2 * total * 10000 + n * 1000000000000) // (2 * n * 1000000000000))::DOUBLE / 10000 AS value FROM s""")
def stream_quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and means of the event log by a stream in append mode; a closing row, far ahead, lets the watermark pass the last day."""
    base = _folder(spark)
    events = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).select("ts", F.lit("end of log").alias("event_type"), F.lit(None).cast("double").alias("value"))
    for rows in (events, end):
        rows.write.mode("append").parquet(f"{base}/log")
        # the whole log is one batch: its files are in no order of time, and the watermark moves between batches
        ingest.run_once(ingest.trend(ingest.documents(spark, f"{base}/log", 1 << 30)), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").where("event_type <> 'end of log'")


@query("session_windows", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(load(spark, sf_dir, "events"))
