"""Document model, sources and search over ``documents``, ``pages`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions import text as fx
from inkstrata.operators import documents as dm
from inkstrata.operators.search import first_hits
from inkstrata.plans.registry import load, query
from inkstrata.sources import files

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SQUEEZE = _STRIP.format("regexp_replace(translate(lower({0}), '$€£¥,', ''), '\\s+', ' ', 'g')")


@query("normalize_text", f"""SELECT doc_id, md5({SQUEEZE.format("text")}) AS locator, md5(translate(lower({_STRIP.format("text")}), '$€£¥,', '')) AS engine,
md5(regexp_replace(translate(lower({_STRIP.format("text")}), '$€£¥,%', ''), '\\s+', ' ', 'g')) AS scored, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(fx.squeeze(t)).alias("locator"), F.md5(fx.plain(t)).alias("engine"), F.md5(fx.scored(t)).alias("scored"), F.md5(fx.key(t)).alias("key"))


_RAW = "CASE WHEN p_size % 4 = 0 THEN '(' || p_size || ')' WHEN p_size % 4 = 1 THEN '$' || p_size || ',000.50' WHEN p_size % 4 = 2 THEN ' yes' ELSE p_name END"


@query("coerce_numbers_bools", f"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part), d AS (SELECT *, try_cast(nullif(regexp_extract(translate(raw, ',$€£¥%', ''), '[-+]?[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS n FROM r)
SELECT p_partkey, CASE WHEN regexp_matches(raw, '^\\s*\\(.*\\)\\s*$') THEN -abs(n) ELSE n END AS number, CASE WHEN lower(trim(raw)) IN ('true','yes','y','1') THEN true WHEN lower(trim(raw)) IN ('false','no','n','0') THEN false END AS flag FROM d""")
def coerce_numbers_bools(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    raw = F.when(size % 4 == 0, F.concat(F.lit("("), size, F.lit(")"))).when(size % 4 == 1, F.concat(F.lit("$"), size, F.lit(",000.50"))).when(size % 4 == 2, " yes").otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", fx.to_number(raw).alias("number"), fx.to_bool(raw).alias("flag"))


@query("json_props", """SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced JSON answers: fence off, parsed, summed."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    k = F.get_json_object(fx.unfence(fenced), "$.k").try_cast("bigint")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k"))


@query("source_kind_dispatch", """WITH n AS (SELECT page_id, list_last(string_split(regexp_extract(url, '^[^?#]*', 0), '/')) AS base FROM pages), e AS (SELECT page_id, lower(regexp_extract(base, '[.]([A-Za-z0-9]+)$', 1)) AS ext FROM n)
SELECT CASE ext WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'text' ELSE 'unknown' END AS kind, count(*) AS files FROM e GROUP BY 1""")
def source_kind_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return load(spark, sf_dir, "pages").groupBy(files.kind_of(path).alias("kind")).agg(F.count("*").alias("files"))


@query("content_hash_inventory", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once; only hashes and ids are shuffled."""
    rows = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


_BLOCKS = """p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS pt, generate_subscripts(string_split(text, chr(12)), 1) - 1 AS page FROM documents),
b AS (SELECT doc_id, page, unnest(list_filter(string_split(pt, chr(10)), lambda x: trim(x) <> '')) AS line FROM p),
w AS (SELECT doc_id, page, unnest(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) AS word FROM b)"""


@query("text_to_pages_blocks_words", f"""WITH {_BLOCKS},
bc AS (SELECT doc_id, count(*) AS blocks FROM b GROUP BY ALL), wc AS (SELECT doc_id, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS chars FROM w GROUP BY ALL)
SELECT doc_id, blocks, words, chars FROM bc JOIN wc USING (doc_id)""")
def text_to_pages_blocks_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dm.words(load(spark, sf_dir, "documents"))
    # a block number is unique in its page, so blocks are counted by their first words
    return words.groupBy("doc_id").agg(F.count_if(F.col("word") == 0).alias("blocks"), F.count("*").alias("words"), F.sum(F.length("text")).alias("chars"))


@query("weak_page_filter", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS pt, generate_subscripts(string_split(text, chr(12)), 1) - 1 AS page FROM documents)
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(length(regexp_replace(pt, '\\s', '', 'g')) AS INTEGER) AS chars FROM p WHERE length(regexp_replace(pt, '\\s', '', 'g')) < 20""")
def weak_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.weak_pages(load(spark, sf_dir, "documents")).select("doc_id", "page", "chars")


_OCR = f"{_BLOCKS}, c AS (SELECT doc_id, CAST(length(word) * 37 % 100 AS DOUBLE) / 100 AS conf FROM w), o AS (SELECT doc_id, round(avg(conf), 4) AS ocr_score, count(*) AS n_words, round(avg(CASE WHEN conf < 0.6 THEN 1.0 ELSE 0.0 END), 4) AS low_share FROM c GROUP BY doc_id)"


@query("ocr_document_confidence", f"WITH {_OCR} SELECT * FROM o")
def ocr_document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dm.words(load(spark, sf_dir, "documents")).withColumn("confidence", dm.word_confidence(F.col("text")))
    return dm.confidence(words, ["doc_id"])


@query("escalation_decision", f"""WITH {_OCR}, x AS (SELECT CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) < 20 * len(string_split(text, chr(12))) THEN 'too little text' WHEN ocr_score IS NULL THEN NULL WHEN ocr_score < 0.6 THEN 'low confidence' WHEN low_share > 0.4 THEN 'many weak words' END AS reason FROM documents LEFT JOIN o USING (doc_id))
SELECT coalesce(reason, 'none') AS reason, count(*) AS documents FROM x GROUP BY 1""")
def escalation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scores = dm.confidence(dm.words(docs).withColumn("confidence", dm.word_confidence(F.col("text"))), ["doc_id"])
    sizes = docs.select("doc_id", F.length(F.regexp_replace("text", "\\s", "")).alias("chars"), F.size(dm.pages_of(F.col("text"))).alias("pages"))
    why = dm.escalation(F.col("chars"), F.col("pages"), F.col("ocr_score"), F.col("low_share"))
    return sizes.join(scores, "doc_id", "left").groupBy(F.coalesce(why, F.lit("none")).alias("reason")).agg(F.count("*").alias("documents"))


@query("search_fallback", """WITH hit AS (SELECT item_id, b.text AS phrase, doc_id, d.text, instr(lower(d.text), lower(b.text)) AS place FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> '')
SELECT item_id, doc_id, CAST(place AS INTEGER) AS place, CASE WHEN place > 20 + 1 THEN '...' ELSE '' END || substring(text, greatest(place - 20, 1), least(place + length(phrase) + 19, length(text)) - greatest(place - 20, 1) + 1) || CASE WHEN least(place + length(phrase) + 19, length(text)) < length(text) THEN '...' ELSE '' END AS context FROM hit""")
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence of each whole benchmark text in each text, with its surroundings."""
    phrases = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return first_hits(load(spark, sf_dir, "documents"), phrases)
