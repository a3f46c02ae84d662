"""Schemas, extraction, parsing, routing, filling and review over the test tables, each with the SQL that checks it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.operators import extraction, filling, parsing, privacy, reports, routing, rules
from inkstrata.operators import schema as sc
from inkstrata.operators.geometry import box
from inkstrata.plans.field_queries import FIELDS
from inkstrata.plans.privacy_queries import FOUND
from inkstrata.plans.registry import dealt, load, query, spread

# --- schemas --------------------------------------------------------------------------------

PART = sc.schema_of({"name": "part", "fields": {
    "name": {"type": "str", "required": True}, "price": {"type": "float", "required": True}, "size": {"type": "int"}, "tags": {"type": "list", "item_type": "str"}, "large": {"type": "bool"}, "codes": {"type": "list", "item_type": "int"},
}})


def part_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a model might answer them: prices with signs, sizes with units, a bare text for a list, lists as text, missing prices, no JSON at all."""
    k, size = F.col("p_partkey"), F.col("p_size")
    price = F.when(k % 6 == 0, "null").when(k % 6 == 1, F.concat(F.lit('"$'), k, F.lit(',000.5"'))).otherwise(F.concat(k, F.lit(".25")))
    tags = F.when(k % 4 == 0, F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).otherwise(F.concat(F.lit('["'), F.col("p_brand"), F.lit('", "x"]')))
    codes = F.when(k % 7 == 0, F.lit('"one long text"')).otherwise(F.concat(F.lit('["('), size, F.lit(')", "7"]')))
    body = F.concat(F.lit('{"name": "'), F.col("p_name"), F.lit('", "price": '), price, F.lit(', "size": "'), size, F.lit(' cm", "tags": '), tags, F.lit(', "large": "'), F.when(size > 25, "Yes").otherwise("no"), F.lit('", "codes": '), codes, F.lit("}"))
    answer = F.when(k % 11 == 0, "sorry").when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return spread(load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_brand"), "p_partkey").select(k.alias("doc_id"), answer.alias("answer"))


_PART = """a AS (SELECT p_partkey AS doc_id, p_partkey % 11 <> 0 AS ok, p_name AS name, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN p_partkey * 1000 + 0.5 ELSE p_partkey + 0.25 END::DOUBLE AS price, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_brand || ',x' END AS tags, p_size > 25 AS large,
CASE WHEN p_partkey % 7 <> 0 THEN -p_size || ',7' END AS codes FROM part)"""


@query("coerce_by_schema", f"""WITH {_PART} SELECT doc_id, CASE WHEN ok THEN name END AS name, CASE WHEN ok THEN price END AS price, CASE WHEN ok THEN size END AS size, CASE WHEN ok THEN tags END AS tags, CASE WHEN ok THEN large END AS large, CASE WHEN ok THEN codes END AS codes,
CASE WHEN NOT ok THEN 'the answer is no object' ELSE concat_ws('; ', CASE WHEN price IS NULL THEN 'price: missing' END, CASE WHEN codes IS NULL THEN 'codes: not a list' END) END AS faults FROM a""")
def coerce_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers brought to the types of a schema, and what does not fit."""
    c = F.col("c")
    rows = part_answers(spark, sf_dir).select("doc_id", sc.coerce_answer(PART, F.col("answer")).alias("c"))
    return rows.select("doc_id", c["data"]["name"].alias("name"), c["data"]["price"].alias("price"), c["data"]["size"].alias("size"), F.array_join(c["data"]["tags"], ",").alias("tags"), c["data"]["large"].alias("large"), F.array_join(c["data"]["codes"].cast("array<string>"), ",").alias("codes"), F.array_join(c["faults"], "; ").alias("faults"))


@query("schema_repair", f"""WITH {_PART}, s AS (SELECT *, CASE WHEN ok AND price IS NOT NULL AND codes IS NOT NULL THEN 'first' WHEN doc_id % 2 = 0 THEN 'repaired' WHEN ok AND price IS NOT NULL THEN 'fallback' ELSE 'failed' END AS source FROM a)
SELECT source, count(*) AS answers, CAST(sum(CASE source WHEN 'first' THEN 2 WHEN 'repaired' THEN 1 WHEN 'fallback' THEN 0 END) AS BIGINT) AS codes FROM s GROUP BY source""")
def schema_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that do not fit are asked for again, which helps every second one; of the rest unusable lists are emptied, other faults stay."""
    first = part_answers(spark, sf_dir)
    again = first.where("doc_id % 2 = 0").select("doc_id", F.lit('{"name": "n", "price": 1.5, "codes": [3]}').alias("answer"))
    return sc.repair(first, PART, again).groupBy("source").agg(F.count("*").alias("answers"), F.sum(F.size("data.codes")).alias("codes"))


# --- extraction -----------------------------------------------------------------------------

CONTACT = sc.schema_of({"name": "contact", "fields": {n: {"type": "str"} for n in FIELDS}})


def reading_model():
    """A stand-in for a model: what patterns find in the document of a question; it misreads numbers at higher temperatures."""
    import re

    compiled = {n: re.compile(p) for n, p in FIELDS.items()}

    def answer(questions: list[str]) -> list[str]:
        out = []
        for q in questions:
            warm = 0.0
            if q.startswith("{"):
                asked = json.loads(q)
                q, warm = asked["question"], asked["temperature"]
            if "Candidate 1:" in q:
                text = q.split("\nDocument:\n", 1)[1].split("\n\nCandidate 1:", 1)[0]
            else:
                text = q.split("Document:\n", 1)[1]
            data = {n: m.group() if (m := p.search(text)) else None for n, p in compiled.items()}
            if warm > 0.3 and data["number"]:
                data["number"] = "0" + data["number"]
            out.append("```json\n" + json.dumps({"data": data, "evidence": {n: {"page": 0, "text": v} for n, v in data.items() if v}}, ensure_ascii=False) + "\n```")
        return out

    return answer


_VALUES = " UNION ALL ".join(f"SELECT doc_id, text, '{n}' AS field, nullif(regexp_extract(text, '{p}', 0), '') AS value FROM documents" for n, p in FIELDS.items())
_SQL_PLAIN = "translate(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '$€£¥,', '')"


@query("extract_single", f"""WITH v AS ({_VALUES}) SELECT doc_id, field, value, coalesce({_SQL_PLAIN.format("value")} <> '' AND contains({_SQL_PLAIN.format("text")}, {_SQL_PLAIN.format("value")}), false) AS found, coalesce({_SQL_PLAIN.format("value")} <> '' AND contains({_SQL_PLAIN.format("text")}, {_SQL_PLAIN.format("value")}), false) AS gate FROM v""")
def extract_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer for each document by a stand-in model, checked against the schema and the text."""
    out = extraction.extract(load(spark, sf_dir, "documents").select("doc_id", "text"), CONTACT, reading_model)
    return out.select("doc_id", "field", "value", "found", "gate")


@query("extract_multi", f"""WITH v AS ({_VALUES}), g AS (SELECT doc_id, field, value, CASE WHEN value IS NULL THEN 1.0 WHEN field = 'number' THEN round(2 / 3, 4) ELSE 1.0 END AS agreement, coalesce({_SQL_PLAIN.format("value")} <> '' AND contains({_SQL_PLAIN.format("text")}, {_SQL_PLAIN.format("value")}), false) AS found FROM v)
SELECT field, count(*) AS documents, count(*) FILTER (WHERE value IS NOT NULL) AS filled, count(*) FILTER (WHERE value IS NOT NULL AND agreement = 1.0 AND found) AS accepted, round(min(CASE WHEN value IS NOT NULL THEN agreement END), 4) AS least_agreement FROM g GROUP BY field""")
def extract_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers at three temperatures, of which the warmest misreads numbers, and a decision where they differ."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").where("length(text) <= 8000").union(load(spark, sf_dir, "documents").select("doc_id", "text").where("length(text) > 8000"))
    out = extraction.extract(docs, CONTACT, reading_model, extraction.Options(mode="multi", instances=3))
    has = F.col("value").isNotNull()
    return out.groupBy("field").agg(F.count("*").alias("documents"), F.count_if(has).alias("filled"), F.count_if(has & F.col("gate")).alias("accepted"), F.round(F.min(F.when(has, F.col("agreement"))), 4).alias("least_agreement"))


# --- parsing --------------------------------------------------------------------------------

#: Words of conversations on pages: 60 characters a row of 12 points, 5 points a character, long words followed by a wide gap.
_PAGES = """t AS (SELECT conv_id * 100 + turn AS doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations), u AS (SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS n FROM t),
b AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ofs FROM u),
w AS (SELECT doc_id, n, text, ofs // 60 AS r, ofs % 60 * 5.0 AS x0, (ofs % 60 + length(text)) * 5.0 - CASE WHEN length(text) > 8 THEN 16 ELSE 0 END AS x1, ofs // 60 * 12.0 + n % 3 AS top FROM b)"""


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    tokens = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    turns = dealt(load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text"), "doc_id")
    rows = turns.select("doc_id", F.posexplode(tokens).alias("n", "text"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    rows = rows.withColumn("at", at).withColumn("r", F.floor(F.col("at") / 60))
    return rows.select("doc_id", F.lit(0).alias("page"), "n", "text", (F.col("at") % 60 * 5.0).alias("x0"), ((F.col("at") % 60 + F.length("text")) * 5.0 - F.when(F.length("text") > 8, 16).otherwise(0)).alias("x1"), (F.col("r") * 12.0 + F.col("n") % 3).alias("top"), (F.col("r") * 12.0 + F.col("n") % 3 + 9).alias("bottom"))


@query("page_lines", f"""WITH {_PAGES}, g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, r ORDER BY x0) <= 18 THEN 0 ELSE 1 END AS new FROM w), l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY r, x0 ROWS UNBOUNDED PRECEDING) - 1 AS line FROM g)
SELECT doc_id, CAST(line AS INTEGER) AS line, string_agg(text, ' ' ORDER BY x0) AS text, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(top + 9) AS y1 FROM l GROUP BY doc_id, line""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of words whose tops differ a little, parted where a gap is wide, as blocks."""
    blocks = parsing.blocks_of_lines(parsing.lines_of_words(page_words(spark, sf_dir)))
    return blocks.select("doc_id", F.col("block").alias("line"), "text", "box.x0", "box.y0", "box.x1", "box.y1")


@query("smart_pages", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS t, generate_subscripts(string_split(text, chr(12)), 1) - 1 AS page FROM documents), n AS (SELECT *, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS size FROM p),
s AS (SELECT *, (size < 20 OR (doc_id % 5 = 0 AND size < 100)) AND doc_id % 3 <> 0 AS used FROM n)
SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE used) AS replaced, md5(string_agg(CASE WHEN used THEN 'read ' || doc_id ELSE t END, chr(10) || chr(10) ORDER BY page)) AS text FROM s GROUP BY doc_id""")
def smart_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak pages give way to what OCR read, which is there for two documents in three."""
    docs = load(spark, sf_dir, "documents")
    native = docs.select("doc_id", F.posexplode(F.split("text", "\\f")).alias("page", "text"), (F.col("doc_id") % 5 == 0).alias("has_image")).withColumn("n_text_blocks", F.lit(1))
    read = native.where("doc_id % 3 <> 0").select("doc_id", "page", F.concat(F.lit("read "), F.col("doc_id")).alias("text"))
    both = parsing.with_recognised(native, read)
    counts = both.groupBy("doc_id").agg(F.count_if(F.col("source") == "ocr").alias("replaced"))
    return parsing.raw_text(both).join(counts, "doc_id").select("doc_id", "pages", "replaced", F.md5("raw_text").alias("text"))


@query("layout_labels", """SELECT event_type, CASE event_type WHEN 'click' THEN 'title' WHEN 'view' THEN 'image' WHEN 'purchase' THEN 'text' ELSE 'text' END AS type, count(*) AS blocks, round(min(100 - value / 100), 6) AS y0, round(max(100 - value / 200), 6) AS y1 FROM events WHERE event_id % 7 <> 0 OR event_type = 'view' GROUP BY ALL""")
def layout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of a layout model: labels to types, boxes from the bottom left turned round, blank items other than pictures left out."""
    label = F.when(F.col("event_type") == "click", "section_header").when(F.col("event_type") == "view", "picture").when(F.col("event_type") == "purchase", "caption").otherwise("something new")
    v = F.col("value")
    items = load(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.lit(0).alias("page"), F.col("event_id").alias("item"), label.alias("label"), F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("event_type")).alias("text"), box(F.lit(0.0), v / 200, F.lit(1.0), v / 100).alias("box"), F.lit("BOTTOMLEFT").alias("origin"), F.lit(100.0).alias("height"), "event_type")
    blocks = parsing.layout_blocks(items).join(items.select("doc_id", "event_type"), "doc_id")
    return blocks.groupBy("event_type", "type").agg(F.count("*").alias("blocks"), F.round(F.min("box.y0"), 6).alias("y0"), F.round(F.max("box.y1"), 6).alias("y1"))


@query("words_of_blocks", f"""WITH {_PAGES}, k AS (SELECT DISTINCT doc_id, q.block, q.type, q.x0 AS bx0, q.x1 AS bx1 FROM w CROSS JOIN (VALUES (0, 'image', 0, 400), (1, 'text', 0, 160), (2, 'title', 150, 400)) AS q(block, type, x0, x1)),
m AS (SELECT w.doc_id, n, text, min(block) AS block FROM w JOIN k USING (doc_id) WHERE type <> 'image' AND (w.x0 + w.x1) / 2 BETWEEN bx0 AND bx1 GROUP BY ALL), s AS (SELECT doc_id, block, count(*) AS words, round(avg(CASE WHEN n % 4 <> 0 THEN n % 10 / 10 END), 6) AS confidence, string_agg(text, ' ' ORDER BY n) AS text FROM m GROUP BY ALL)
SELECT k.doc_id, k.block, coalesce(words, 0) AS words, confidence, coalesce(text, '') AS text FROM k LEFT JOIN s USING (doc_id, block)""")
def words_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words in the first block that holds their centre; pictures hold none; the block's confidence is the mean of its words'."""
    w = page_words(spark, sf_dir)
    words = w.select("doc_id", "page", F.col("n").alias("cell"), "text", F.when(F.col("n") % 4 != 0, F.col("n") % 10 / 10).alias("confidence"), box(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(2.0)).alias("box"))
    three = F.array(*[F.struct(F.lit(i).alias("block"), F.lit(t).alias("type"), box(F.lit(a), F.lit(0.0), F.lit(z), F.lit(10.0)).alias("box")) for i, t, a, z in ((0, "image", 0.0, 400.0), (1, "text", 0.0, 160.0), (2, "title", 150.0, 400.0))])
    blocks = w.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(three).alias("b")).select("doc_id", "page", "b.*")
    out = parsing.attach_words(blocks, words)
    return out.select("doc_id", "block", F.size("words").cast("bigint").alias("words"), F.round("confidence", 6).alias("confidence"), F.array_join("words", " ").alias("text"))


@query("lines_by_offsets", f"""WITH {_PAGES}, o AS (SELECT doc_id, n, text, ofs FROM b), l AS (SELECT DISTINCT doc_id, ofs // 80 AS line FROM o), h AS (SELECT o.doc_id, line, n, text FROM o JOIN l ON o.doc_id = l.doc_id AND (ofs >= line * 80 AND ofs < line * 80 + 30 OR ofs >= line * 80 + 50 AND ofs < line * 80 + 80)),
s AS (SELECT doc_id, line, count(*) AS words, round(avg(n % 10 / 10), 6) AS confidence FROM h GROUP BY ALL) SELECT l.doc_id, l.line, coalesce(words, 0) AS words, confidence FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.line = s.line""")
def lines_by_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two spans each, with the words whose offset is in one of them, as reading services answer."""
    from pyspark.sql import Window

    tokens = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), F.posexplode(tokens).alias("n", "text")).withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))
    words = rows.select("doc_id", F.lit(0).alias("page"), "offset", "text", (F.col("n") % 10 / 10).alias("confidence"))
    span = lambda a, n: F.struct((F.col("line") * 80 + a).alias("offset"), F.lit(n).alias("length"))
    lines = rows.select("doc_id", F.lit(0).alias("page"), F.floor(F.col("offset") / 80).alias("line")).distinct().withColumn("spans", F.array(span(0, 30), span(50, 30)))
    out = parsing.lines_by_spans(lines, words)
    return out.select("doc_id", "line", F.size("words").cast("bigint").alias("words"), F.round("confidence", 6).alias("confidence"))


@query("lines_by_child_ids", """WITH w AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
SELECT o_orderkey AS doc_id, count(l_partkey) AS words, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY n) FILTER (WHERE l_partkey IS NOT NULL) AS text, round(coalesce(avg(l_quantity / 100), o_custkey % 100 / 100), 6) AS confidence FROM orders LEFT JOIN w ON o_orderkey = l_orderkey AND n <= 3 GROUP BY o_orderkey, o_custkey""")
def lines_by_child_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines that name up to three words (lineitems) by id; ids of no word are left out; confidences come in percent."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = load(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
    words = l.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("w"), F.col("n")).alias("id"), F.lit("WORD").alias("type"), F.col("l_partkey").cast("string").alias("text"), F.col("l_quantity").alias("confidence"), F.lit(None).cast("array<string>").alias("children"))
    lines = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("line").alias("id"), F.lit("LINE").alias("type"), F.lit("").alias("text"), (F.col("o_custkey") % 100).cast("double").alias("confidence"), F.array(F.lit("w1"), F.lit("w2"), F.lit("w3"), F.lit("gone")).alias("children"))
    out = parsing.lines_by_children(lines.unionByName(words).withColumn("page", F.lit(0)))
    return out.select("doc_id", F.size("words").cast("bigint").alias("words"), F.nullif(F.array_join("words", " "), F.lit("")).alias("text"), F.round("confidence", 6).alias("confidence"))


@query("lines_by_anchor_ranges", """WITH l AS (SELECT doc_id, i AS line, i * 50 AS a, i * 50 + 40 AS z, text FROM documents, range(3) AS r(i)), t AS (SELECT doc_id, j AS token, j * 17 AS a, substring(text, CAST(j * 17 + 1 AS BIGINT), 5) || substring(text, CAST(j * 17 + 11 AS BIGINT), 3) AS word FROM documents, range(8) AS r(j) WHERE j % 4 <> 3),
h AS (SELECT l.doc_id, line, count(*) AS words, string_agg(trim(word), '|' ORDER BY t.a) AS tokens, round(avg(token / 10), 6) AS mean FROM l JOIN t ON l.doc_id = t.doc_id AND t.a >= l.a AND t.a < l.z GROUP BY ALL)
SELECT l.doc_id, l.line, trim(substring(text, CAST(l.a + 1 AS BIGINT), 40)) AS text, coalesce(words, 0) AS words, coalesce(tokens, '') AS tokens, coalesce(mean, 0.5) AS confidence FROM l LEFT JOIN h ON l.doc_id = h.doc_id AND l.line = h.line""")
def lines_by_anchor_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and tokens as pieces of a text; a token without segments is left out, a line without tokens keeps its own confidence."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    seg = lambda a, n: F.struct(F.when(a > 0, a).cast("int").alias("start"), (a + n).cast("int").alias("end"))
    lines = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line")).select("doc_id", F.lit(0).alias("page"), F.col("line").cast("bigint").alias("line"), F.array(seg(F.col("line") * 50, 40)).alias("segments"), F.lit(0.5).alias("confidence"))
    tokens = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("token")).select("doc_id", F.lit(0).alias("page"), "token", F.when(F.col("token") % 4 == 3, F.array().cast("array<struct<start: int, end: int>>")).otherwise(F.array(seg(F.col("token") * 17, 5), seg(F.col("token") * 17 + 10, 3))).alias("segments"), (F.col("token") / 10).alias("confidence"))
    out = parsing.lines_by_anchors(docs, lines, tokens)
    return out.select("doc_id", "line", "text", F.size("words").cast("bigint").alias("words"), F.array_join("words", "|").alias("tokens"), F.round("confidence", 6).alias("confidence"))


@query("recognised_lines", f"""WITH {_PAGES}, g AS (SELECT doc_id, n, text, CAST(n * 37 % 120 - 10 AS DOUBLE) AS conf, n // 4 AS line_num FROM b), k AS (SELECT * FROM g WHERE conf >= 0), l AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_num) - 1 AS line FROM k)
SELECT doc_id, CAST(line AS INTEGER) AS line, string_agg(text, ' ' ORDER BY n) AS text, round(avg(conf / 100), 6) AS confidence, round(min(n % 4 * 50) * 0.36::DOUBLE, 6) AS x0 FROM l GROUP BY doc_id, line""")
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rows of an OCR engine as lines: negative confidences are other levels, pixels at 200 dpi become points."""
    w = page_words(spark, sf_dir)
    rows = w.select("doc_id", "page", F.col("n").alias("item"), F.lit(0).alias("block_num"), F.lit(0).alias("par_num"), F.floor(F.col("n") / 4).alias("line_num"), "text", (F.col("n") * 37 % 120 - 10).cast("double").alias("conf"), (F.col("n") % 4 * 50).alias("left"), F.lit(10).alias("top"), F.lit(40).alias("width"), F.lit(12).alias("height"))
    blocks = parsing.blocks_of_lines(parsing.recognised_lines(rows), "confidence")
    return blocks.select("doc_id", F.col("block").cast("int").alias("line"), "text", F.round("confidence", 6).alias("confidence"), F.round("box.x0", 6).alias("x0"))


# --- routing and splitting ------------------------------------------------------------------


def naming_model():
    """A stand-in for a classifier: licences and dialogue by a word, everything else as something that is not registered."""

    def answer(questions: list[str]) -> list[str]:
        out = []
        for q in questions:
            begin = q.split("The document begins:\n", 1)[1]
            name = "licence" if "icens" in begin else "letter" if "the" in begin else "poem"
            out.append(json.dumps({"workflow": name, "confidence": 0.4 if len(begin) % 7 == 0 else 0.9, "reason": ""}))
        return out

    return answer


@query("routed_documents", """WITH h AS (SELECT doc_id, text[1:2000] AS begin FROM documents), c AS (SELECT *, length(trim(begin)) >= 50 AS enough, CASE WHEN contains(begin, 'icens') THEN 'licence' WHEN contains(begin, 'the') THEN 'letter' ELSE 'poem' END AS name, CASE WHEN length(begin) % 7 = 0 THEN 0.4 ELSE 0.9 END AS sure FROM h),
r AS (SELECT *, CASE WHEN enough AND name <> 'poem' AND sure >= 0.5 THEN name END AS workflow FROM c)
SELECT CAST(doc_id AS VARCHAR) AS file_name, coalesce(workflow, 'unclassified') AS workflow, CASE WHEN enough THEN printf('%.2f', sure::DOUBLE) ELSE '0.00' END AS classification_confidence, CASE WHEN workflow = 'letter' AND doc_id % 4 = 0 OR workflow IS NULL THEN 'False' ELSE 'True' END AS success, CASE WHEN workflow IS NULL THEN '' ELSE '0.50' END AS extraction_confidence, CASE WHEN workflow IS NULL THEN '' WHEN workflow = 'licence' THEN 'True' ELSE 'False' END AS needs_review,
CASE WHEN workflow = 'letter' AND doc_id % 4 = 0 THEN 'torn' WHEN workflow IS NOT NULL THEN '' WHEN NOT enough THEN 'classification failed: no text to classify by' WHEN name = 'poem' THEN 'no registered workflow: poem' ELSE name || ', but confidence 0.40 is below 0.5' END AS error FROM r""")
def routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents classified by their beginning and run through the workflow of their kind, as the rows of the report."""
    router = routing.Router()
    router.register("licence", lambda d: d.select("doc_id", F.lit(True).alias("success"), F.lit(0.5).alias("confidence"), F.lit(True).alias("needs_review")), "texts with a licence")
    router.register("letter", lambda d: d.select("doc_id", (F.col("doc_id") % 4 != 0).alias("success"), F.lit(0.5).alias("confidence"), F.lit(False).alias("needs_review"), F.when(F.col("doc_id") % 4 == 0, "torn").alias("error")), "any other English text")
    return routing.routed_csv(router.route(load(spark, sf_dir, "documents").select("doc_id", "text"), naming_model))


@query("split_sections", """WITH a AS (SELECT conv_id, max(turn) AS last, CASE WHEN conv_id % 5 = 0 THEN 'bad' WHEN conv_id % 5 = 1 THEN 'list' ELSE 'object' END AS kind FROM conversations GROUP BY conv_id), p AS (SELECT DISTINCT conv_id, turn FROM conversations),
w AS (SELECT conv_id, kind, 'body' AS section, unnest([last + 1, last, 0]) AS page FROM a WHERE kind <> 'bad' UNION ALL SELECT conv_id, kind, 'annex', last FROM a WHERE kind = 'object'), j AS (SELECT w.*, p.turn IS NOT NULL AS there FROM w LEFT JOIN p ON w.conv_id = p.conv_id AND w.page = p.turn),
s AS (SELECT conv_id, section, string_agg(CASE WHEN there THEN CAST(page AS VARCHAR) END, ',' ORDER BY page) AS pages, string_agg(DISTINCT CASE WHEN NOT there THEN CAST(page AS VARCHAR) END, ', ') AS gone FROM j GROUP BY ALL)
SELECT a.conv_id AS doc_id, q.section, coalesce(pages, '') AS pages, CASE WHEN a.kind = 'object' AND q.section = 'annex' THEN 'low' ELSE 'high' END AS confidence, 'section ' || q.section || ': no pages ' || gone AS warning FROM a CROSS JOIN (VALUES ('body'), ('annex')) AS q(section) LEFT JOIN s ON s.conv_id = a.conv_id AND s.section = q.section""")
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about the sections of a conversation: objects, bare lists, and no JSON; pages it lacks go with a warning."""
    pages = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    body = F.concat(F.lit("["), F.col("last") + 1, F.lit(", "), F.col("last"), F.lit(", 0]"))
    full = F.concat(F.lit('{"sections": {"body": {"pages": '), body, F.lit('}, "annex": {"pages": ['), F.col("last"), F.lit('], "confidence": "low"}}}'))
    answer = F.when(F.col("doc_id") % 5 == 0, "sorry").when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"sections": {"body": '), body, F.lit("}}"))).otherwise(full)
    out = routing.sections_of(last.select("doc_id", answer.alias("output")), pages, ["body", "annex"])
    return out.select("doc_id", "section", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "confidence", "warning")


# --- filling --------------------------------------------------------------------------------


def _form(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as data of three fields, and a form with a checkbox that only odd ones have."""
    c = dealt(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "c_custkey")
    row = lambda f, i, v, k, a: F.struct(F.lit(f).alias("field"), F.lit(i).alias("pos"), v.alias("value"), F.lit(k).alias("kind"), F.array(F.lit(f), F.lit(a)).alias("aliases"), F.lit("").alias("description"), F.lit(None).cast("string").alias("mapped"))
    fields = c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(row("name", 0, F.col("c_name"), "str", "Customer Name"), row("rich", 1, F.when(F.col("c_acctbal") > 5000, "True").otherwise("False"), "bool", "wealthy"), row("segment", 2, F.col("c_mktsegment"), "str", "sector"))).alias("f")).select("doc_id", "f.*")
    target = lambda t, k, o: F.struct(F.lit(t).alias("target"), F.lit(k).alias("control"), o.alias("options"))
    none = F.array().cast("array<string>")
    form = F.concat(F.array(target("customer_name", "text", none), target("spare", "text", none)), F.when(F.col("c_custkey") % 2 == 1, F.array(target("wealthy", "checkbox", F.when(F.col("c_custkey") % 3 == 0, none).otherwise(F.array(F.lit("On"))))) ).otherwise(F.array().cast("array<struct<target: string, control: string, options: array<string>>>")))
    targets = c.select(F.col("c_custkey").alias("doc_id"), F.explode(form).alias("t")).select("doc_id", "t.*", F.lit(0).alias("page"), box(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("box"))
    return fields, targets


@query("fill_plan", """SELECT c_custkey AS doc_id, q.field, CASE q.field WHEN 'name' THEN 'customer_name' WHEN 'rich' THEN CASE WHEN c_custkey % 2 = 1 THEN 'wealthy' END END AS target, CASE q.field WHEN 'name' THEN 'normalized_alias' WHEN 'rich' THEN CASE WHEN c_custkey % 2 = 1 THEN 'exact_alias' END END AS method,
CASE q.field WHEN 'name' THEN c_name WHEN 'segment' THEN c_mktsegment WHEN 'rich' THEN CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_acctbal > 5000 THEN 'True' ELSE 'False' END WHEN c_acctbal <= 5000 THEN 'Off' WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'On' END END AS text FROM customer CROSS JOIN (VALUES ('name'), ('rich'), ('segment')) AS q(field)""")
def fill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, targets = _form(spark, sf_dir)
    return filling.acroform_plan(fields, targets).select("doc_id", "field", "target", "method", "text")


@query("fill_unmapped", """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 1 THEN 'segment' ELSE 'rich,segment' END AS unmapped, 'spare' AS left_over, 'no form field for: ' || CASE WHEN c_custkey % 2 = 1 THEN 'segment' ELSE 'rich, segment' END AS warning, 0 AS errors, CASE WHEN c_custkey % 2 = 1 THEN 'not placed: segment' ELSE 'not placed: rich, segment' END AS reasons FROM customer""")
def fill_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without a place, form fields without a value, and why a person should look."""
    fields, targets = _form(spark, sf_dir)
    plan = filling.acroform_plan(fields, targets)
    rows = filling.unmapped(plan, targets).join(filling.review_reasons(plan), "doc_id")
    return rows.select("doc_id", F.array_join("unmapped", ",").alias("unmapped"), F.array_join("left_over", ",").alias("left_over"), F.col("warnings")[0].alias("warning"), F.size("errors").alias("errors"), F.array_join("reasons", "; ").alias("reasons"))


@query("fill_log", """WITH l AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'approve' WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'reject' ELSE 'force' END AS action, value FROM events),
v AS (SELECT *, first_value(CASE WHEN action IN ('approve', 'reject') THEN action END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM l), c AS (SELECT *, action = 'commit' AND coalesce(was = 'approve', false) OR action = 'force' AND coalesce(was <> 'reject', true) AS commits FROM v),
d AS (SELECT *, coalesce(bool_or(commits) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM c), o AS (SELECT *, CASE action WHEN 'edit' THEN NOT done AND coalesce(was <> 'reject', true) WHEN 'approve' THEN was IS NULL WHEN 'reject' THEN was IS NULL ELSE commits AND NOT done END AS ok FROM d)
SELECT doc_id, CASE arg_min(action, seq) FILTER (WHERE ok AND action IN ('approve', 'reject')) WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status, bool_or(ok AND action IN ('commit', 'force')) AS committed, count(*) FILTER (WHERE NOT ok) AS refused, coalesce(CAST(arg_max(round(value, 2), seq) FILTER (WHERE ok AND action = 'edit') AS VARCHAR), 'first') AS text FROM o GROUP BY doc_id""")
def fill_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as edits, decisions and commits of a planned fill: what is allowed when, and what is left in the end."""
    from pyspark.sql import Window

    from inkstrata.functions.text import text_of

    e = load(spark, sf_dir, "events")
    kind = F.col("event_type")
    action = F.when(kind == "click", "edit").when(kind == "view", "approve").when(kind == "purchase", "commit").when(kind == "signup", "reject").otherwise("force")
    log = e.select(F.col("user_id").alias("doc_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), action.alias("action"), F.lit("total").alias("field"), text_of(F.round("value", 2)).alias("value"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>").alias("box"))
    plan = log.select("doc_id", "field", F.lit("first").alias("value"), F.lit("first").alias("text"), "page", "box").distinct()
    rows, state = filling.fold_log(plan, log)
    return state.join(rows.select("doc_id", "text"), "doc_id").select("doc_id", "status", "committed", "refused", "text")


# --- review ---------------------------------------------------------------------------------


@query("review_rules", """WITH f AS (SELECT c_custkey, c_acctbal > 0 AS g1, c_nationkey % 2 = 0 AS g2, CASE WHEN c_acctbal > 2000 THEN 'x' END AS v1, 'y' AS v2, c_nationkey % 3 = 0 AS e1, c_nationkey % 5 <> 0 AS e2 FROM customer)
SELECT c_custkey, CASE WHEN NOT g1 AND NOT g2 THEN 'field a is not trusted; field b is not trusted' WHEN NOT g1 THEN 'field a is not trusted' WHEN NOT g2 THEN 'field b is not trusted' END AS untrusted, CASE WHEN NOT g1 THEN 'field a is not trusted' WHEN NOT g2 THEN 'field b is not trusted' END AS first_untrusted,
nullif('no evidence: ' || concat_ws(', ', CASE WHEN v1 IS NOT NULL AND NOT e1 THEN 'a' END, CASE WHEN NOT e2 THEN 'b' END), 'no evidence: ') AS evidence, 'missing: ' || concat_ws(', ', CASE WHEN v1 IS NULL THEN 'a' END, 'c') AS missing FROM f""")
def review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the fields of a result: untrusted ones by name and the first of all, values without evidence, critical ones that are missing."""
    one = lambda n, v, g, e: F.struct(F.lit(n).alias("field"), v.cast("string").alias("value"), g.alias("gate"), e.alias("evidence"))
    n = F.col("c_nationkey")
    fields = F.array(one("a", F.when(F.col("c_acctbal") > 2000, "x"), F.col("c_acctbal") > 0, n % 3 == 0), one("b", F.lit("y"), n % 2 == 0, n % 5 != 0))
    rows = load(spark, sf_dir, "customer").select("c_custkey", fields.alias("f"))
    f = F.col("f")
    return rows.select("c_custkey", rules.fields_untrusted(f, {"a": 0.5, "b": 0.1, "c": 0.9}).alias("untrusted"), rules.first_untrusted(f).alias("first_untrusted"), rules.without_evidence(f).alias("evidence"), rules.critical_missing(f, ["a", "b", "c"]).alias("missing"))


@query("first_decisions", """WITH l AS (SELECT user_id AS doc_id, ts, CASE WHEN event_type = 'click' THEN 'approved' WHEN event_type = 'view' THEN 'rejected' END AS status, event_id FROM events) SELECT doc_id, arg_min(status, event_id) AS status, min(event_id) AS at, count(*) - 1 AS refused FROM l WHERE status IS NOT NULL GROUP BY doc_id""")
def first_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several decisions about a document the first stays."""
    log = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "view", "rejected").otherwise("opened").alias("decision"), F.lit("me").alias("by"), F.lit("").alias("reason"))
    return rules.decide(log, "doc_id", "event_id").select("doc_id", "status", "at", "refused")


@query("corrected_fields", """WITH f AS (SELECT c_custkey AS doc_id, 'click' AS field, 'first' AS value FROM customer UNION ALL SELECT c_custkey, 'view', 'second' FROM customer), l AS (SELECT user_id AS doc_id, event_type AS field, event_id, props AS value FROM events),
c AS (SELECT doc_id, field, arg_max(value, event_id) AS value, count(*) AS n FROM l GROUP BY ALL) SELECT f.doc_id, f.field, coalesce(c.value, f.value) AS value, CASE WHEN c.n IS NOT NULL THEN f.value END AS original, c.n IS NOT NULL AS corrected, coalesce(c.n, 0) AS corrections FROM f LEFT JOIN c USING (doc_id, field)""")
def corrected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields after a log of corrections, with what they were before the first."""
    one = lambda n, v: F.struct(F.lit(n).alias("field"), F.lit(v).alias("value"))
    fields = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(one("click", "first"), one("view", "second"))).alias("f")).select("doc_id", "f.*")
    log = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"), "event_id", F.col("props").alias("value"), F.lit("me").alias("by"), F.lit("").alias("reason"))
    return rules.correct(fields, log, "doc_id", "event_id")[0].select("doc_id", "field", "value", "original", "corrected", "corrections")


@query("highlight_boxes", """WITH e AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber % 3 AS field, l_linenumber AS n, l_quantity AS x FROM lineitem), r AS (SELECT doc_id, field, n AS page, x FROM e WHERE n % 2 = 0 UNION ALL SELECT doc_id, field, n + 1, x + 1 FROM e WHERE n % 2 = 0 UNION ALL SELECT doc_id, field, n, x FROM e WHERE n % 2 = 1 UNION ALL SELECT doc_id, field, 9, 0.0 FROM e WHERE n = 3)
SELECT doc_id, field, page, count(*) AS rects, min(x) AS x0, CASE field WHEN 'f1' THEN 0 ELSE 1 END AS colour FROM r WHERE field IN ('f1', 'f0') GROUP BY ALL""")
def highlight_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of the evidence of two fields, else its box, and those of OCR places, with the field's colour."""
    l = load(spark, sf_dir, "lineitem")
    b = lambda x: box(x, F.lit(0.0), x + 1, F.lit(1.0))
    n = F.col("l_linenumber")
    rect = lambda p, x: F.struct(p.cast("int").alias("page"), b(x).alias("box"))
    none = F.array().cast("array<struct<page: int, box: struct<x0: double, y0: double, x1: double, y1: double>>>")
    ev = l.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), n % 3).alias("field"), n.alias("page"), F.when(n % 2 == 1, b(F.col("l_quantity"))).alias("box"), F.when(n % 2 == 0, F.array(rect(n, F.col("l_quantity")), rect(n + 1, F.col("l_quantity") + 1))).otherwise(none).alias("rects"))
    ocr = l.where("l_linenumber = 3").select(F.col("l_orderkey").alias("doc_id"), F.lit("f0").alias("field"), F.lit(9).alias("page"), b(F.lit(0.0)).alias("box"), none.alias("rects"))
    return reports.highlight_rects(ev, ocr, ["f1", "f0"]).groupBy("doc_id", "field", "page", "colour").agg(F.count("*").alias("rects"), F.min("box.x0").alias("x0"))


# --- privacy --------------------------------------------------------------------------------


@query("anonymized_pages", f"""WITH {FOUND}, o AS (SELECT doc_id, b, e, printf('%s_%03d', entity, n) AS r, coalesce(lag(e) OVER w, 0) AS prev, lead(b) OVER w IS NULL AS last FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY b, e)),
s AS (SELECT o.doc_id, string_agg(substring(text, prev + 1, b - prev) || r || CASE WHEN last THEN substring(text, e + 1) ELSE '' END, '' ORDER BY b, e) AS text FROM o JOIN documents USING (doc_id) GROUP BY o.doc_id), t AS (SELECT doc_id, count(DISTINCT printf('%s_%03d', entity, n)) AS tokens FROM numbered GROUP BY doc_id)
SELECT doc_id, md5(coalesce(s.text, documents.text)) AS text, coalesce(tokens, 0) AS tokens FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)""")
def anonymized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the policy's providers, pseudonyms numbered through a document, pages joined again."""
    policy = privacy.Policy(entities=tuple(privacy.PATTERNS))
    pages = load(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), "text")
    found = privacy.detect_by(pages, lambda: [privacy.PatternTerms({p: e for e, p in privacy.PATTERNS.items()})])
    hidden, tokens = privacy.anonymize_pages(pages, found, policy)
    counts = tokens.groupBy("doc_id").agg(F.count_distinct("token").alias("tokens"))
    return privacy.require_anonymized(hidden).join(counts, "doc_id", "left").select("doc_id", F.md5("text").alias("text"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
