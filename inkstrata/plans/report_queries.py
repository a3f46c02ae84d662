"""Batch, route, comparison, quality and evaluation reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstrata.functions.text import plain
from inkstrata.operators import reports
from inkstrata.plans.field_queries import AGREED, trusted
from inkstrata.plans.registry import load, query


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results: P failed, F approved; cheap or urgent ones need review."""
    urgent, cheap = F.startswith("o_orderpriority", F.lit("1")), F.col("o_totalprice") < 100000
    reasons = F.filter(F.array(F.when(cheap, "low confidence"), F.when(urgent, F.concat(F.lit("priority "), F.col("o_orderpriority"))), F.when(F.col("o_orderstatus") == "O", "open")), lambda x: x.isNotNull())
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") != "P").alias("success"), (urgent | cheap).alias("needs_review"), (F.col("o_orderstatus") == "F").alias("approved"), (F.col("o_totalprice") / 500000).alias("confidence"), reasons.alias("reasons"))


_RES = """r AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS year, o_orderstatus <> 'P' AS success, (o_orderpriority LIKE '1%' OR o_totalprice < 100000) AS needs_review, o_orderstatus = 'F' AS approved, o_totalprice / 500000 AS confidence,
list_filter([CASE WHEN o_totalprice < 100000 THEN 'low confidence' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'priority ' || o_orderpriority END, CASE WHEN o_orderstatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL) AS reasons FROM orders)"""
_BATCH = "count(*) AS total, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed, count(*) FILTER (WHERE success AND needs_review) AS needs_review, count(*) FILTER (WHERE success AND approved) AS approved, round(coalesce(avg(CASE WHEN success THEN confidence END), 0.0), 6) AS confidence"


@query("batch_report", f"WITH {_RES} SELECT year, {_BATCH} FROM r GROUP BY year")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.batch(results(spark, sf_dir), ["year"])


@query("top_review_reasons", f"WITH {_RES} SELECT reason, count(*) AS count FROM (SELECT unnest(reasons) AS reason FROM r WHERE needs_review) GROUP BY reason ORDER BY count DESC LIMIT 10")
def top_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_reasons(results(spark, sf_dir).where("needs_review"), "o_orderkey")


@query("batch_wide_table", f"""WITH {AGREED} SELECT doc_id, max(CASE WHEN field = 'email' THEN norm END) AS email, max(CASE WHEN field = 'number' THEN norm END) AS number, max(CASE WHEN field = 'address' THEN norm END) AS address, max(CASE WHEN field = 'first_word' THEN norm END) AS first_word FROM gated GROUP BY doc_id""")
def batch_wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trusted(load(spark, sf_dir, "documents")).select("doc_id", "field", plain(F.col("value")).alias("value"))
    return rows.groupBy("doc_id").pivot("field", ["email", "number", "address", "first_word"]).agg(F.max("value"))


@query("routed_report", f"""WITH {AGREED}, d AS (SELECT doc_id, lang, avg(CASE WHEN gate THEN 1.0 ELSE 0.0 END) AS confidence FROM gated GROUP BY ALL),
r AS (SELECT *, CASE WHEN confidence < 0.25 THEN 'unclassified' WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE 'unclassified' END AS workflow FROM d)
SELECT workflow, count(*) AS documents, count(*) FILTER (WHERE confidence < 0.5 AND workflow <> 'unclassified') AS failed, printf('%d documents by %s', count(*), workflow) AS summary FROM r GROUP BY workflow""")
def routed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as workflows: an unregistered one or little confidence leaves a document unclassified."""
    docs = trusted(load(spark, sf_dir, "documents")).groupBy("doc_id", "lang").agg(F.avg(F.col("gate").cast("int")).alias("confidence"))
    flow = F.when(F.col("confidence") < 0.25, "unclassified").when(F.col("lang").isin("en", "de", "fr"), F.col("lang")).otherwise("unclassified")
    rows = docs.select(flow.alias("workflow"), "confidence").groupBy("workflow").agg(F.count("*").alias("documents"), F.count_if((F.col("confidence") < 0.5) & (F.col("workflow") != "unclassified")).alias("failed"))
    return rows.withColumn("summary", F.format_string("%d documents by %s", "documents", "workflow"))


@query("compare_fields", """WITH f AS (SELECT c_nationkey, c_custkey, x.field AS field, x.value AS value FROM (SELECT c_nationkey, c_custkey, unnest([{'field': 'segment', 'value': c_mktsegment}, {'field': 'rich', 'value': CASE WHEN c_acctbal > 5000 THEN 'yes' END}]) AS x FROM customer) WHERE x.value IS NOT NULL),
e AS (SELECT d.c_nationkey, d.c_custkey, n.field, coalesce(f.value, '') AS value FROM (SELECT DISTINCT c_nationkey, c_custkey FROM f) d JOIN (SELECT DISTINCT c_nationkey, field FROM f) n USING (c_nationkey) LEFT JOIN f USING (c_nationkey, c_custkey, field)),
v AS (SELECT c_nationkey, field, value, count(*) AS n FROM e GROUP BY ALL)
SELECT c_nationkey, field, count(*) AS distinct_values, count(*) <= 1 AS agree, max(n) AS most, arg_min(value, struct_pack(a := -n, b := value)) AS most_common FROM v GROUP BY ALL""")
def compare_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation compared in two fields; the second is absent for some."""
    pair = lambda n, v: F.struct(F.lit(n).alias("field"), v.alias("value"))
    rows = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.explode(F.array(pair("segment", F.col("c_mktsegment")), pair("rich", F.when(F.col("c_acctbal") > 5000, "yes")))).alias("x"))
    return reports.compare(rows.select("c_nationkey", "c_custkey", "x.*").where("value is not null"), "c_nationkey", "c_custkey")


def quality_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence: the value has more than three characters; corrected: one document in four."""
    rows = trusted(load(spark, sf_dir, "documents"))
    return rows.withColumn("evidence", F.coalesce(F.length(plain(F.col("value"))) > 3, F.lit(False))).withColumn("corrected", F.col("doc_id") % 4 == 0)


_QUALITY = f"""{AGREED},
q AS (SELECT *, coalesce(length(norm) > 3, false) AS evidence, doc_id % 4 = 0 AS corrected FROM gated),
s AS (SELECT doc_id, round(count(norm) / count(*), 4) AS completeness, {", ".join(f"round(coalesce(count(*) FILTER (WHERE norm IS NOT NULL AND {c}) / nullif(count(norm), 0), 0.0), 4) AS {n}" for c, n in (("evidence", "evidence_rate"), ("found", "grounding_rate"), ("gate", "accept_rate"), ("corrected", "correction_rate")))} FROM q GROUP BY doc_id),
t AS (SELECT *, round(0.15::DOUBLE * completeness + 0.25::DOUBLE * evidence_rate + 0.25::DOUBLE * grounding_rate + 0.35::DOUBLE * accept_rate, 4) AS score FROM s)"""


@query("quality_single", f"WITH {_QUALITY} SELECT * FROM t")
def quality_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality(quality_fields(spark, sf_dir), "doc_id")


@query("quality_batch", f"WITH {_QUALITY} SELECT lang, count(*) AS documents, round(avg(score), 4) AS score, round(avg(completeness), 4) AS completeness, round(avg(accept_rate), 4) AS accept_rate FROM t JOIN documents USING (doc_id) GROUP BY lang")
def quality_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the rounded figures of the documents; the language travels with the document, so there is no join."""
    fields = quality_fields(spark, sf_dir).withColumn("key", F.struct("doc_id", "lang"))
    docs = reports.quality(fields, "key")
    return docs.groupBy(F.col("key.lang").alias("lang")).agg(F.count("*").alias("documents"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("completeness"), 4).alias("completeness"), F.round(F.avg("accept_rate"), 4).alias("accept_rate"))


@query("quality_worst_fields", f"""WITH {_QUALITY}, u AS (SELECT doc_id, field, pos, 0.3 * evidence::INT + 0.3 * found::INT + 0.4 * gate::INT AS s FROM q WHERE norm IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, pos) AS rank FROM u WHERE s < 1) SELECT doc_id, field, CAST(rank AS INTEGER) AS rank, CAST(round(s * 10) AS INTEGER) AS tenths FROM k WHERE rank <= 3""")
def quality_worst_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worst_fields(quality_fields(spark, sf_dir), "doc_id").select("doc_id", "field", "rank", F.round(F.col("field_score") * 10).cast("int").alias("tenths"))


@query("quality_log_history", """WITH x AS (SELECT user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, value - lead(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS change FROM events)
SELECT user_id, CAST(n AS INTEGER) AS n, event_type, k, value, round(change, 4) AS change FROM x WHERE n <= 3""")
def quality_log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three snapshots of each user's log and the change to the one before."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"), "value", F.row_number().over(w).alias("n"), F.round(F.col("value") - F.lead("value").over(w), 4).alias("change"))
    return rows.where("n <= 3")


_EVAL = """p AS (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'class ' ELSE '' END || CAST(CASE WHEN n_chars > 200 THEN 1 ELSE 0 END AS VARCHAR) AS quality, CASE WHEN contains(lower(text), 'scum') THEN '1' WHEN n_chars % 11 = 0 THEN NULL ELSE '0' END AS toxic, n_chars % 2 = 0 AS found, n_chars % 3 = 0 AS corrected FROM documents WHERE n_chars % 13 <> 0),
t AS (SELECT doc_id, 'quality' AS field, CAST(quality AS VARCHAR) AS expected FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels),
o AS (SELECT field, predicted, corrected, CASE WHEN got IS NULL THEN 'missing' WHEN got = expected THEN 'exact' WHEN contains(got, expected) OR contains(expected, got) THEN 'fuzzy' WHEN NOT found THEN 'hallucinated' ELSE 'wrong' END AS outcome FROM (SELECT t.field, expected, p.doc_id IS NOT NULL AS predicted, coalesce(corrected, false) AS corrected, CASE WHEN t.field = 'quality' THEN p.quality ELSE p.toxic END AS got, found FROM t LEFT JOIN p USING (doc_id)))"""


def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the truth for two rules on the text; one document in thirteen has no prediction."""
    l, d = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").where("n_chars % 13 <> 0")
    pair = lambda n, v, k: F.struct(F.lit(n).alias("field"), v.cast("string").alias(k))
    truth = l.select("doc_id", F.explode(F.array(pair("quality", F.col("quality"), "expected"), pair("toxic", F.col("toxic"), "expected"))).alias("t")).select("doc_id", "t.*")
    rough = F.concat(F.when(F.col("n_chars") % 5 == 0, "class ").otherwise(""), (F.col("n_chars") > 200).cast("int").cast("string"))
    guess = F.array(pair("quality", rough, "value"), pair("toxic", F.when(F.contains(F.lower("text"), F.lit("scum")), 1).when(F.col("n_chars") % 11 == 0, F.lit(None)).otherwise(0), "value"))
    predicted = d.select("doc_id", F.explode(guess).alias("p"), (F.col("n_chars") % 2 == 0).alias("found")).select("doc_id", "p.*", "found", F.lit(1).alias("order"))
    rows = reports.evaluate(truth, predicted, ["doc_id", "field"])
    known = d.select("doc_id", (F.col("n_chars") % 3 == 0).alias("corrected"), F.lit(True).alias("known"))
    return rows.join(known, "doc_id", "left").withColumn("predicted", F.col("known").isNotNull()).withColumn("corrected", F.coalesce("corrected", F.lit(False)))


@query("eval_report", f"""WITH {_EVAL} SELECT field, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE outcome = '{x}') AS {x}" for x in ("exact", "fuzzy", "missing", "hallucinated", "wrong"))}, round(count(*) FILTER (WHERE outcome IN ('exact', 'fuzzy')) / count(*), 4) AS accuracy FROM o GROUP BY field""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.accuracy(eval_outcomes(spark, sf_dir), ["field"])


@query("eval_overall", f"""WITH {_EVAL} SELECT round(count(*) FILTER (WHERE outcome IN ('exact', 'fuzzy')) / count(*), 4) AS accuracy, round(count(*) FILTER (WHERE outcome = 'hallucinated') / count(*), 4) AS hallucination_rate, round(count(*) FILTER (WHERE corrected AND outcome <> 'missing') / count(*), 4) AS correction_rate FROM o WHERE predicted""")
def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all fields of the documents that have a prediction."""
    return reports.overall(eval_outcomes(spark, sf_dir))


@query("quality_worst_of_batch", f"""WITH {_QUALITY}, u AS (SELECT field, min(pos) AS pos, CAST(sum(CAST(CASE WHEN norm IS NULL THEN 0.0 ELSE 0.3 * evidence::INT + 0.3 * found::INT + 0.4 * gate::INT END AS DECIMAL(38,12))) / count(*) AS DOUBLE) AS mean FROM q GROUP BY field), l AS (SELECT CAST(sum(CAST(score AS DECIMAL(38,12))) / count(score) AS DOUBLE) AS level FROM t)
SELECT field, round(mean, 6) AS mean, CAST(row_number() OVER (ORDER BY mean, pos) AS INTEGER) AS rank FROM u, l WHERE mean < level QUALIFY row_number() OVER (ORDER BY mean, pos) <= 5""")
def quality_worst_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_fields(spark, sf_dir)
    return reports.worst_of_batch(rows, reports.quality(rows, "doc_id")).select("field", F.round("mean", 6).alias("mean"), "rank")


@query("field_differences", """WITH d AS (SELECT n_nationkey AS doc_id, n_nationkey AS o FROM nation), f AS (SELECT n_nationkey AS doc_id, 'region' AS field, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'kind', 'nation' FROM nation UNION ALL SELECT n_nationkey, 'long', 'yes' FROM nation WHERE length(n_name) > 8),
e AS (SELECT n.field, d.o, coalesce(f.value, 'None') AS v FROM d CROSS JOIN (SELECT DISTINCT field FROM f) n LEFT JOIN f ON f.doc_id = d.doc_id AND f.field = n.field), c AS (SELECT field, v, count(*) AS n, min(o) AS first FROM e GROUP BY ALL), s AS (SELECT field, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS total, string_agg(v, ',' ORDER BY first) AS unique_values, list(v ORDER BY n DESC, first) AS vs, list(n ORDER BY n DESC, first) AS ns FROM c GROUP BY field)
SELECT field, kinds <= 1 AS all_agree, unique_values, CASE WHEN kinds <= 1 THEN 'all ' || total || ' documents agree: ' || unique_values ELSE array_to_string(list_transform(range(1, len(vs) + 1), lambda i: ns[i] || '/' || total || ' say ' || vs[i]), ', ') END AS summary FROM s""")
def field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents, compared in three fields of which one is absent for some."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    docs = n.select(F.col("n_nationkey").alias("doc_id"), F.col("n_nationkey").alias("o"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    pair = lambda k, v: F.struct(F.lit(k).alias("field"), v.alias("value"))
    fields = rows.select(F.col("n_nationkey").alias("doc_id"), F.explode(F.array(pair("region", F.col("r_name")), pair("kind", F.lit("nation")), pair("long", F.when(F.length("n_name") > 8, "yes")))).alias("x")).select("doc_id", "x.*").where("value is not null")
    return reports.differences(fields, docs, "o").select("field", "all_agree", F.array_join("unique_values", ",").alias("unique_values"), "summary")


@query("shard_results", """WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS shard, l_returnflag AS field, CAST(l_partkey AS VARCHAR) AS value, l_linestatus = 'O' AS gate, CAST(l_quantity AS BIGINT) AS tokens, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS cost, CASE WHEN l_linenumber > 1 THEN l_discount END AS ocr, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
y AS (SELECT * FROM x WHERE k = 1), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY shard DESC) AS r FROM y)
SELECT y.doc_id, (SELECT string_agg(field || '=' || value, ',' ORDER BY field) FROM f WHERE f.doc_id = y.doc_id AND r = 1) AS fields, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(CAST(cost AS DECIMAL(38,12))) AS DOUBLE), 6) AS cost, arg_min(ocr, shard) FILTER (WHERE ocr IS NOT NULL) AS ocr, (SELECT round(avg(CASE WHEN gate THEN 1.0 ELSE 0.0 END), 6) FROM f WHERE f.doc_id = y.doc_id AND r = 1) AS confidence FROM y GROUP BY y.doc_id""")
def shard_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as results of shards of one field each."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = load(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1")
    parts = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("shard"), F.create_map("l_returnflag", F.col("l_partkey").cast("string")).alias("fields"), F.create_map("l_returnflag", F.col("l_linestatus") == "O").alias("gates"), F.col("l_quantity").cast("bigint").alias("tokens"), F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("cost"), F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("ocr"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return reports.merged_shards(parts).select("doc_id", text.alias("fields"), "tokens", "cost", "ocr", F.round("confidence", 6).alias("confidence"))
