"""Candidates, consensus, trust and verification over fields taken from ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as fx
from inkstrata.operators import rules, trust, verification
from inkstrata.plans.registry import load, query

#: field -> expression that finds it; the order is the schema's.
FIELDS = {"email": "[A-Za-z0-9.]+@[A-Za-z0-9.]+[A-Za-z]", "number": "[0-9]+", "first_word": "[^ \\n]+", "address": "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"}
INSTANCES = 5


#: What a text must contain for a field to be there at all: a cheap test before the pattern.
_NEEDS = {"email": "@", "address": "."}
#: A match begins where a run of its letters does, so that a long run is tried once and not from each of its letters.
_FAST = {"email": "(?<![A-Za-z0-9.])" + FIELDS["email"], "address": "(?<![0-9])" + FIELDS["address"]}


def _found(text: Column, field: str) -> Column:
    hit = fx.let(F.regexp_extract(text, _FAST.get(field, FIELDS[field]), 0), lambda x: F.nullif(x, F.lit("")))
    return F.when(F.contains(text, F.lit(_NEEDS[field])), hit) if field in _NEEDS else hit


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, source (the text as values are compared with it) and ``fields``: field, pos and the values of all instances.

    The instances read the text thrice, in lower case, and without its first line; each of the three texts is searched once.
    """
    parts = docs.select("doc_id", "lang", "text", F.lower("text").alias("low"), F.regexp_replace("text", "^[^\\n]*\\n", "").alias("rest"))
    found = [_found(F.col(c), n).alias(f"{n}_{c}") for n in FIELDS for c in ("text", "low", "rest")]
    rows = parts.select("doc_id", "lang", "text", fx.plain(F.col("text")).alias("source"), *found)
    fields = [F.struct(F.lit(n).alias("field"), F.lit(i).alias("pos"), F.array(*[F.col(f"{n}_{c}") for c in ("text", "text", "text", "low", "rest")]).alias("values")) for i, n in enumerate(FIELDS)]
    return rows.select("doc_id", "lang", "text", "source", F.array(*fields).alias("fields"))


def assessed(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and ``fields``: field, pos, values, a (what ``assess`` gives) and found; still one row for each document."""
    known = candidates(docs).select("doc_id", "lang", "text", "source", F.transform("fields", lambda f: F.struct(f["field"], f["pos"], f["values"], trust.assess(f["values"]).alias("a"))).alias("fields"))
    found = lambda f: F.coalesce((f["a"]["norm"] != "") & F.contains(F.col("source"), f["a"]["norm"]), F.lit(False))
    return known.select("doc_id", "lang", "text", F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["pos"].alias("pos"), f["values"].alias("values"), f["a"].alias("a"), found(f).alias("found"))).alias("fields"))


def each_field(docs: DataFrame, *columns: str) -> DataFrame:
    """One row for each field of ``assessed``; the text stays behind unless it is asked for.

    The outer form, as the planner would put a test that the list is not empty, and with it all of its making, before the plain one.
    """
    return assessed(docs).select("doc_id", "lang", *columns, F.explode_outer("fields").alias("f")).select("doc_id", "lang", *columns, "f.*")


_VARIANTS = ["text", "text", "text", "lower(text)", "regexp_replace(text, '^[^\\n]*\\n', '')"]
CANDIDATES = " UNION ALL ".join(
    f"SELECT doc_id, lang, text, {i} AS instance, '{n}' AS field, {pos} AS pos, nullif(regexp_extract({v}, '{p}', 0), '') AS value FROM documents"
    for pos, (n, p) in enumerate(FIELDS.items()) for i, v in enumerate(_VARIANTS, 1)
)
PLAIN = "translate(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '$€£¥,', '')"
#: doc, field: values in the largest group, how many there are, the majority's value, agreement and grounding.
AGREED = f"""
c AS ({CANDIDATES}),
n AS (SELECT *, {PLAIN.format("value")} AS norm FROM c),
g AS (SELECT doc_id, field, norm, count(*) AS k, min(instance) AS first FROM n WHERE norm IS NOT NULL GROUP BY ALL),
top AS (SELECT doc_id, field, max(k) AS k, sum(k) AS present, count(*) AS kinds, arg_min(norm, struct_pack(a := -k, b := first)) AS norm, arg_min(first, struct_pack(a := -k, b := first)) AS first FROM g GROUP BY ALL),
f AS (SELECT n.doc_id, n.lang, n.field, n.pos, coalesce(top.k, 0) AS k, coalesce(present, 0) AS present, coalesce(kinds, 0) AS kinds, top.norm,
  (SELECT NULL) AS unused, round(top.k / top.present, 4) AS agreement, coalesce(top.norm <> '' AND contains({PLAIN.format("n.text")}, top.norm), false) AS found
  FROM n LEFT JOIN top USING (doc_id, field) WHERE n.instance = 1),
gated AS (SELECT *, found AND (present <= 1 OR agreement = 1.0) AS gate FROM f)"""


def trusted(docs: DataFrame) -> DataFrame:
    a = F.col("a")
    return each_field(docs).select("doc_id", "lang", "field", "pos", "values", F.col("a.value").alias("value"), trust.agreement_of(a).alias("agreement"), "found", trust.gate_of(a, F.col("found")).alias("gate"))


@query("field_trust_report", f"""WITH {AGREED},
d AS (SELECT doc_id, lang, avg(CASE WHEN gate THEN 1.0 ELSE 0.0 END) AS confidence, count(*) FILTER (WHERE gate) AS gated FROM gated GROUP BY ALL)
SELECT lang, count(*) AS documents, round(avg(confidence), 4) AS confidence, CAST(sum(gated) AS BIGINT) AS gated_fields, count(*) FILTER (WHERE confidence = 1) AS trusted_documents FROM d GROUP BY lang""")
def field_trust_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = F.transform("fields", lambda f: trust.gate_of(f["a"], f["found"]).cast("int"))
    sums = assessed(load(spark, sf_dir, "documents")).select("doc_id", "lang", F.aggregate(gates, F.lit(0), lambda s, x: s + x).cast("bigint").alias("gated"), F.size("fields").alias("n"))
    # the gates of a document are in its row already; rows of one id are one document
    per_doc = sums.groupBy("doc_id", "lang").agg((F.sum("gated") / F.sum("n")).alias("confidence"), F.sum("gated").alias("gated"))
    return per_doc.groupBy("lang").agg(F.count("*").alias("documents"), F.round(F.avg("confidence"), 4).alias("confidence"), F.sum("gated").alias("gated_fields"), F.count_if(F.col("confidence") == 1).alias("trusted_documents"))


@query("consensus_scores", f"""WITH {AGREED},
agree AS (SELECT gated.doc_id, gated.field, count(*) FILTER (WHERE n.norm = gated.norm) AS same FROM gated JOIN n USING (doc_id, field) GROUP BY ALL)
SELECT doc_id, field, round(same / {INSTANCES}, 4) AS consensus, round(k / {INSTANCES}, 4) AS cluster_share, agreement, (present = {INSTANCES} AND kinds = 1) AS unanimous FROM gated JOIN agree USING (doc_id, field)""")
def consensus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    share = F.round(a["top"] / a["total"], 4)
    return each_field(load(spark, sf_dir, "documents")).select("doc_id", "field", share.alias("consensus"), share.alias("cluster_share"), trust.agreement_of(a).alias("agreement"), ((a["present"] == a["total"]) & (a["kinds"] == 1)).alias("unanimous"))


@query("decider_skips", f"""WITH {AGREED}, d AS (SELECT doc_id, lang, bool_and(present = 0 OR (present = {INSTANCES} AND kinds = 1)) AS unanimous FROM gated GROUP BY ALL)
SELECT lang, count(*) FILTER (WHERE unanimous) AS skipped, count(*) FILTER (WHERE NOT unanimous) AS decided FROM d GROUP BY lang""")
def decider_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose candidates agree in every field seen anywhere need no decider."""
    agree = F.forall("fields", lambda f: (f["a"]["present"] == 0) | (f["a"]["present"] == f["a"]["total"]) & (f["a"]["kinds"] == 1))
    docs = assessed(load(spark, sf_dir, "documents")).select("doc_id", "lang", agree.alias("agree")).groupBy("doc_id", "lang").agg(F.every("agree").alias("unanimous"))
    return docs.groupBy("lang").agg(F.count_if("unanimous").alias("skipped"), F.count_if(~F.col("unanimous")).alias("decided"))


@query("candidate_temperatures", """SELECT c_custkey, n, CASE WHEN n = 1 THEN [0.3] ELSE list_transform(range(n), lambda i: round(greatest(0.0, least(1.0, 0.15::DOUBLE + i * (0.3::DOUBLE / greatest(n - 1, 1)))), 3)) END[k] AS temperature, k FROM (
SELECT c_custkey, 1 + c_nationkey % 6 AS n, unnest(range(1, 2 + c_nationkey % 6)) AS k FROM customer)""")
def candidate_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select("c_custkey", (1 + F.col("c_nationkey") % 6).cast("bigint").alias("n"))
    return rows.select("c_custkey", "n", F.posexplode(fx.temperatures(F.col("n").cast("int"))).alias("k", "temperature")).withColumn("k", (F.col("k") + 1).cast("bigint"))


@query("schema_shards", """WITH f AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, CAST(floor(pos / ceil(n / least(4, n))) AS BIGINT) AS shard, count(*) AS fields, min(c_custkey) AS first_field, max(c_custkey) AS last_field FROM f GROUP BY ALL""")
def schema_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous groups of the fields (customers) of each schema (nation), at most four."""
    rows = verification.shards(load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 4)
    return rows.groupBy("c_nationkey", "shard").agg(F.count("*").alias("fields"), F.min("c_custkey").alias("first_field"), F.max("c_custkey").alias("last_field"))


_WEAK = f"""{AGREED},
agree AS (SELECT gated.*, round(same / {INSTANCES}, 4) AS consensus FROM gated JOIN (SELECT gated.doc_id, gated.field, count(*) FILTER (WHERE n.norm = gated.norm) AS same FROM gated JOIN n USING (doc_id, field) GROUP BY ALL) USING (doc_id, field)),
weak AS (SELECT *, CASE WHEN consensus < 0.7 THEN 'consensus' WHEN NOT found AND norm IS NOT NULL THEN 'unmatched' END AS reason FROM agree)"""


@query("verification_queue", f"""WITH {_WEAK}
SELECT doc_id, field, reason, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM weak WHERE reason IS NOT NULL) WHERE rank <= 5""")
def verification_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five weak fields of each document in schema order, with the first reason that holds."""
    rows = each_field(load(spark, sf_dir, "documents")).select("doc_id", "field", "pos", F.col("a.value").alias("value"), F.round(F.col("a.top") / F.col("a.total"), 4).alias("consensus"), "found")
    return verification.queue(rows).select("doc_id", "field", "reason", "rank")


@query("verification_apply", f"""WITH {AGREED},
v AS (SELECT gated.*, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'other' ELSE norm END AS verified FROM gated),
a AS (SELECT *, coalesce(verified = norm, false) AS agrees, verified IS NOT NULL AND NOT coalesce(verified = norm, false) AS applied FROM v),
r AS (SELECT *, CASE WHEN agrees OR applied THEN true ELSE gate END AS new_gate FROM a)
SELECT doc_id, CAST(count(*) FILTER (WHERE agrees) AS BIGINT) AS confirmed, count(*) FILTER (WHERE applied) AS applied, count(*) FILTER (WHERE verified IS NULL) AS unreadable, round(avg(CASE WHEN new_gate THEN 1.0 ELSE 0.0 END), 4) AS confidence FROM r GROUP BY doc_id""")
def verification_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reading: unreadable for one document in five, another value for one in five, else the same."""
    rows = trusted(load(spark, sf_dir, "documents"))
    turn = F.col("doc_id") % 5
    second = rows.select("doc_id", "field", F.when(turn == 0, F.lit(None)).when(turn == 1, "other").otherwise(fx.plain(F.col("value"))).alias("verified"))
    done = verification.apply(rows, second, ["doc_id", "field"])
    return done.groupBy("doc_id").agg(F.count_if("agrees").alias("confirmed"), F.count_if("applied").alias("applied"), F.count_if(F.col("verified").isNull()).alias("unreadable"), F.round(F.avg(F.col("gate").cast("int")), 4).alias("confidence"))


@query("validation_errors", """WITH f AS (SELECT c_custkey, unnest([{'field': 'name', 'value': c_name}, {'field': 'balance', 'value': CASE WHEN c_acctbal >= 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END}, {'field': 'segment', 'value': CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END}]) AS x FROM customer),
g AS (SELECT c_custkey, x.field AS field, x.value AS value FROM f WHERE NOT (c_custkey % 7 = 0 AND x.field = 'name')),
r AS (SELECT c_custkey, q.field, g.value, g.field IS NOT NULL AS present FROM customer CROSS JOIN (VALUES ('name'), ('balance'), ('segment')) AS q(field) LEFT JOIN g USING (c_custkey, field)),
e AS (SELECT c_custkey, field, 'required: field is missing' AS message, 2 AS severity FROM r WHERE NOT present UNION ALL SELECT c_custkey, field, 'required: value is null', 2 FROM r WHERE present AND value IS NULL
UNION ALL SELECT c_custkey, field, 'type: value is empty', 1 FROM r WHERE value = '' UNION ALL SELECT c_custkey, field, 'evidence: value without evidence', 2 FROM r WHERE value IS NOT NULL AND field = 'segment' AND c_custkey % 3 = 0)
SELECT c_custkey, field, max(severity) = 2 AS is_error, count(*) AS messages, string_agg(message, '; ' ORDER BY message) AS message FROM e GROUP BY ALL""")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as results with three fields; every seventh lacks its name, every third its evidence of the segment."""
    c = load(spark, sf_dir, "customer")
    field = lambda n, v: F.struct(F.lit(n).alias("field"), v.alias("value"))
    fields = F.array(field("name", F.col("c_name")), field("balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string"))), field("segment", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))))
    rows = c.select("c_custkey", F.explode(fields).alias("f")).select("c_custkey", "f.field", "f.value", ((F.col("f.field") != "segment") | (F.col("c_custkey") % 3 != 0)).alias("evidence"))
    rows = rows.where(~((F.col("c_custkey") % 7 == 0) & (F.col("field") == "name")))
    return rules.validate(rows, c.select("c_custkey"), "c_custkey", required=["name", "balance", "segment"], typed=["name", "balance", "segment"], evidenced=["segment"])


@query("review_reasons", """WITH r AS (SELECT o_orderkey, o_totalprice / 500000 AS confidence, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, o_orderstatus FROM orders),
x AS (SELECT o_orderkey, 1 AS k, 'confidence below 0.70' AS reason FROM r WHERE confidence < 0.7 UNION ALL SELECT o_orderkey, 2, 'missing: priority' FROM r WHERE priority IS NULL UNION ALL SELECT o_orderkey, 3, '1 validation errors' FROM r WHERE o_orderstatus = 'P')
SELECT o_orderkey, count(*) AS n_reasons, string_agg(reason, '; ' ORDER BY k) AS reasons FROM x GROUP BY o_orderkey""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 500000).alias("confidence"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"), (F.col("o_orderstatus") == "P").cast("int").alias("errors"))
    out = rules.review(o, [rules.confidence_below(F.col("confidence"), 0.7), rules.fields_missing({"priority": F.col("priority")}), rules.has_errors(F.col("errors"))])
    return out.where("needs_review").select("o_orderkey", F.size("reasons").cast("bigint").alias("n_reasons"), F.array_join("reasons", "; ").alias("reasons"))


@query("correction_fold", """SELECT user_id, event_type AS field, count(*) AS corrections, arg_min(value, struct_pack(a := ts, b := event_id)) AS original, arg_max(value, struct_pack(a := ts, b := event_id)) AS corrected FROM events GROUP BY ALL""")
def correction_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of corrections: the last one of a field wins, the first value stays as the original."""
    return rules.fold(load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), "ts", "event_id", "value"), ["user_id", "field"], ["ts", "event_id"])


@query("status_queues", """SELECT CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'pending_review' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS queue, count(*) AS results FROM orders GROUP BY 1""")
def status_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"), F.startswith("o_orderpriority", F.lit("1")).alias("needs_review"))
    return o.groupBy(rules.status_queue(F.col("status"), F.col("needs_review")).alias("queue")).agg(F.count("*").alias("results"))


@query("usage_sum", """SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS tokens, round(sum(CASE WHEN l_returnflag <> 'N' THEN l_tax END), 6) AS cost FROM lineitem GROUP BY l_orderkey""")
def usage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of the calls (lines) of a document (order); the cost is null only if every call's is."""
    cost = F.when(F.col("l_returnflag") != "N", F.col("l_tax"))
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("tokens"), F.round(F.sum(cost), 6).alias("cost"))


@query("shard_merge", """WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS field, l_partkey AS value, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_partkey DESC) AS k FROM lineitem)
SELECT l_orderkey, field, value FROM x WHERE k = 1""")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as shards' fields: the later shard wins."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("field"), F.col("l_partkey").alias("value"))
    return rows.groupBy("l_orderkey", "field").agg(F.max_by("value", F.struct("l_linenumber", "value")).alias("value"))


@query("field_provenance", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, max(CASE WHEN k = 1 THEN event_type END) AS last_correction, string_agg(CASE WHEN k <= 3 THEN event_type END, ',' ORDER BY k) AS verdicts FROM x GROUP BY user_id""")
def field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last correction and the latest three verdicts of each field, without values."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(last).alias("k")).where("k <= 3")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"])
    return rows.groupBy("user_id").agg(F.max(F.when(F.col("k") == 1, F.col("event_type"))).alias("last_correction"), F.array_join(ordered, ",").alias("verdicts"))
