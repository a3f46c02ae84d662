"""Privacy over ``documents``, ``events`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.operators import privacy
from inkstrata.plans.registry import load, query

_ONE = " UNION ALL ".join(
    f"SELECT doc_id, '{e}' AS entity, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM documents WHERE regexp_matches(text, '{p}')" for e, p in privacy.PATTERNS.items()
)
#: findings: doc_id, entity, b, e, value; numbered: and the pseudonym's number.
FOUND = f"""one AS ({_ONE}), each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM one),
found AS (SELECT doc_id, entity, m[i] AS value, length(array_to_string(p[1:i], '')) + coalesce(length(array_to_string(m[1:i-1], '')), 0) AS b FROM each),
numbered AS (SELECT *, b + length(value) AS e, dense_rank() OVER (PARTITION BY doc_id, entity ORDER BY lb DESC) AS n FROM (SELECT *, max(b) OVER (PARTITION BY doc_id, entity, value) AS lb FROM found))"""


def _spliced(by: str) -> str:
    """SQL for texts with findings replaced; pieces between findings and replacements in order of place."""
    return f"""{FOUND}, o AS (SELECT doc_id, b, e, {by} AS r, coalesce(lag(e) OVER w, 0) AS prev, lead(b) OVER w IS NULL AS last FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY b, e)),
s AS (SELECT o.doc_id, string_agg(substring(text, prev + 1, b - prev) || r || CASE WHEN last THEN substring(text, e + 1) ELSE '' END, '' ORDER BY b, e) AS text FROM o JOIN documents USING (doc_id) GROUP BY o.doc_id)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


@query("pii_detect_counts", f"WITH {FOUND} SELECT doc_id, entity, count(*) AS findings, min(b) AS first_begin, max(e) AS last_end FROM numbered GROUP BY ALL")
def pii_detect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.detect(_texts(spark, sf_dir))
    return found.groupBy("doc_id", "entity").agg(F.count("*").alias("findings"), F.min("begin").cast("bigint").alias("first_begin"), F.max("end").cast("bigint").alias("last_end"))


def _anonymized(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _texts(spark, sf_dir)
        return privacy.anonymize(docs, privacy.detect(docs), mode)

    return run


for _mode, _by in (("redact", "'[REDACTED]'"), ("mask", "CASE WHEN length(value) > 1 THEN value[1] || repeat('*', length(value) - 1) ELSE '*' END"), ("hash", "left(sha256(value), 16)"), ("pseudonymize", "printf('%s_%03d', entity, n)")):
    query(f"pii_{_mode}", f"WITH {_spliced(_by)} SELECT doc_id, coalesce(s.text, documents.text) AS text FROM documents LEFT JOIN s USING (doc_id)")(_anonymized(_mode))


@query("pii_pseudonyms", f"WITH {FOUND} SELECT DISTINCT doc_id, printf('%s_%03d', entity, n) AS token, value FROM numbered")
def pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.mappings(privacy.detect(_texts(spark, sf_dir)))


@query("pii_restore_roundtrip", f"WITH {_spliced("printf('%s_%03d', entity, n)")} SELECT count(*) AS documents, count(*) FILTER (WHERE s.text <> documents.text) AS changed, count(*) AS restored FROM documents LEFT JOIN s USING (doc_id)")
def pii_restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymised texts that restoring makes equal to what they were."""
    docs = _texts(spark, sf_dir)
    found = privacy.detect(docs)
    hidden = privacy.anonymize(docs.withColumn("was", F.sha2("text", 256)), found, "pseudonymize").withColumn("changed", F.sha2("text", 256) != F.col("was"))
    back = privacy.restore(hidden, privacy.mappings(found))
    return back.agg(F.count("*").alias("documents"), F.count_if("changed").alias("changed"), F.count_if(F.sha2("text", 256) == F.col("was")).alias("restored"))


@query("pii_risk", f"""WITH {FOUND}, x AS (SELECT doc_id, sum(e - b) AS chars, count(*) FILTER (WHERE entity IN ('CREDIT_CARD', 'IP_ADDRESS')) AS high, count(DISTINCT entity) AS kinds FROM numbered GROUP BY doc_id)
SELECT doc_id, round(least(0.5::DOUBLE * least(coalesce(chars / nullif(length(text), 0), 0.0), 1.0) + least(0.1::DOUBLE * coalesce(high, 0), 0.3) + least(0.05::DOUBLE * coalesce(kinds, 0), 0.2), 1.0), 4) AS risk FROM documents LEFT JOIN x USING (doc_id)""")
def pii_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return privacy.risk(docs, privacy.detect(docs))


@query("scrub_event_props", """SELECT event_id, regexp_replace(props || ' from ' || user_id || '@host' || event_id || '.example.com', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,6}', '[SCRUBBED]', 'g') AS props FROM events""")
def scrub_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = F.concat("props", F.lit(" from "), "user_id", F.lit("@host"), "event_id", F.lit(".example.com"))
    return load(spark, sf_dir, "events").select("event_id", privacy.scrub(trace).alias("props"))


@query("dictionary_terms", """WITH f AS (SELECT p_brand AS root, p_name AS term, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT root, term, root || '_' || dense_rank() OVER (PARTITION BY root ORDER BY first) AS token FROM f""")
def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered replacements of the names under each brand, in the order of the list."""
    rows = load(spark, sf_dir, "part").select(F.col("p_brand").alias("root"), F.col("p_name").alias("term"), "p_partkey")
    return privacy.numbered_terms(rows, "root", "p_partkey")
