"""Words on pages, tables and forms over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as fx
from inkstrata.operators import documents as dm
from inkstrata.operators import forms, geometry, privacy, tables
from inkstrata.plans.privacy_queries import FOUND
from inkstrata.plans.registry import dealt, load, query


#: Words of conversations: (conv_id, turn) is a page, x runs with the characters of the turn.
_WORDS = """t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations),
u AS (SELECT conv_id, turn, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS word FROM t),
w AS (SELECT conv_id, turn, word, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id, turn ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM u),
x AS (SELECT *, b + length(text) AS e FROM w)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    rows = dealt(load(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.posexplode(tokens).alias("word", "text"))
    return geometry.with_offsets(rows, ["conv_id", "turn"], "word")


@query("word_line_range_join", f"""WITH {_WORDS}, z AS (SELECT conv_id, turn, max(e) AS e FROM x GROUP BY conv_id, turn), l AS (SELECT conv_id, turn, unnest(range(0, CAST((e + 39) // 40 AS BIGINT))) AS line FROM z)
SELECT conv_id, turn, line, count(*) AS words, min(b) AS first_begin FROM x JOIN l USING (conv_id, turn) WHERE b >= line * 40 AND b < line * 40 + 40 GROUP BY ALL""")
def word_line_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lines of 40 characters by half-open ranges of offsets, within a turn."""
    w = words(spark, sf_dir)
    lines = w.groupBy("conv_id", "turn").agg(F.max("end").alias("size")).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / 40))).alias("line"))
    lines = lines.select("conv_id", "turn", F.col("line").cast("bigint").alias("line"), (F.col("line") * 40).alias("line_begin"), (F.col("line") * 40 + 40).alias("line_end"))
    return geometry.words_of_lines(w, lines, ["conv_id", "turn"]).groupBy("conv_id", "turn", "line").agg(F.count("*").alias("words"), F.min("begin").cast("bigint").alias("first_begin"))


@query("line_grouping_gaps", f"""WITH {_WORDS}, g AS (SELECT *, CASE WHEN length(text) > 9 THEN 1 ELSE 0 END AS wide, b - lag(e) OVER (PARTITION BY conv_id, turn ORDER BY word) AS gap FROM x),
p AS (SELECT *, lag(wide) OVER (PARTITION BY conv_id, turn ORDER BY word) AS before FROM g),
n AS (SELECT *, sum(CASE WHEN coalesce(gap + before * 4, 0) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY word ROWS UNBOUNDED PRECEDING) AS line FROM p)
SELECT conv_id, turn, CAST(line AS BIGINT) AS line, count(*) AS words FROM n GROUP BY ALL""")
def line_grouping_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap (wider after long words) of more than three begins a line."""
    w = words(spark, sf_dir).withColumn("stop", F.col("end") - F.when(F.length("text") > 9, 4).otherwise(0))
    return dm.lines_by_gap(w, ["conv_id", "turn"], "word", "begin", "stop", 3).groupBy("conv_id", "turn", "line").agg(F.count("*").alias("words"))


@query("word_block_spatial_join", f"""WITH {_WORDS}, c AS (SELECT conv_id, turn, word, (b + e) / 2 AS cx FROM x), k AS (SELECT DISTINCT conv_id, turn, q.block, q.x0, q.x1 FROM x CROSS JOIN (VALUES (0, 0, 60), (1, 50, 150), (2, 150, 100000)) AS q(block, x0, x1)),
m AS (SELECT conv_id, turn, word, min(block) AS block FROM c JOIN k USING (conv_id, turn) WHERE cx BETWEEN x0 AND x1 GROUP BY ALL) SELECT conv_id, block, count(*) AS words FROM m GROUP BY ALL""")
def word_block_spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three overlapping blocks that holds a word's centre."""
    w = words(spark, sf_dir).select("conv_id", "turn", "word", F.col("begin").cast("double").alias("x0"), F.col("end").cast("double").alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"))
    three = F.array(*[F.struct(F.lit(i).alias("block"), F.lit(a).alias("bx0"), F.lit(z).alias("bx1"), F.lit(0.0).alias("by0"), F.lit(10.0).alias("by1")) for i, a, z in ((0, 0.0, 60.0), (1, 50.0, 150.0), (2, 150.0, 100000.0))])
    blocks = load(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().select("conv_id", "turn", F.explode(three).alias("b")).select("conv_id", "turn", "b.*")
    return geometry.block_of_words(w, blocks, ["conv_id", "turn"]).groupBy("conv_id", "block").agg(F.count("*").alias("words"))


@query("finding_overlap", f"""WITH {FOUND}, ws AS (SELECT doc_id, regexp_extract_all(text, '[^ ]+') AS m, string_split_regex(text, '[^ ]+') AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM found)),
wi AS (SELECT doc_id, unnest(m) AS word, unnest(p[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM ws),
x AS (SELECT doc_id, i, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS BIGINT) AS wb, length(word) AS wn FROM wi)
SELECT doc_id, entity, count(*) AS touched_words FROM x JOIN numbered USING (doc_id) WHERE wb < e AND wb + wn > b GROUP BY ALL""")
def finding_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words (between blanks) that a finding touches."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = privacy.detect(docs)
    some = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return geometry.overlaps(geometry.words_with_gaps(some), found, ["doc_id"]).groupBy("doc_id", "entity").agg(F.count("*").alias("touched_words"))


@query("child_id_join", """SELECT o_orderkey, count(l_orderkey) AS children, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def child_id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (orders) with their words (lineitems): children are pre-aggregated, so a line's key is shuffled once."""
    l = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("children"), F.sum("l_quantity").alias("quantity"))
    joined = load(spark, sf_dir, "orders").select("o_orderkey").join(l, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("children", F.lit(0)).cast("bigint").alias("children"), F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("quantity"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a table: a header row, and a row for each line with part, quantity and flag."""
    cell = lambda i, t: F.struct(F.lit(i).alias("col"), t.cast("string").alias("text"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    data = load(spark, sf_dir, "lineitem").withColumn("row", F.row_number().over(w))
    own = F.transform(F.array(cell(0, F.col("l_partkey")), cell(1, F.col("l_quantity").cast("int")), cell(2, F.col("l_returnflag"))), lambda c: F.struct(F.col("row"), F.lit(False).alias("is_header"), c["col"].alias("col"), c["text"].alias("text")))
    heads = F.transform(F.array(cell(0, F.lit("part")), cell(1, F.lit("quantity"))), lambda c: F.struct(F.lit(0).alias("row"), F.lit(True).alias("is_header"), c["col"].alias("col"), c["text"].alias("text")))
    return data.select("l_orderkey", F.explode(F.when(F.col("row") == 1, F.concat(heads, own)).otherwise(own)).alias("c")).select("l_orderkey", "c.*")


@query("table_records", """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS row, CAST(l_partkey AS VARCHAR) AS part, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity, l_returnflag AS col_2 FROM lineitem""")
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.records(cells(spark, sf_dir), ["l_orderkey"], ["part", "quantity", "col_2"])


@query("table_columns", """WITH c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row, l_partkey FROM lineitem) SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY row) AS parts FROM c GROUP BY l_orderkey""")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_values(cells(spark, sf_dir), ["l_orderkey"], 0).select("l_orderkey", F.array_join("texts", ",").alias("parts"))


@query("bbox_algebra", """WITH b AS (SELECT l_orderkey, l_partkey, l_quantity AS x0, l_linenumber * 10.0::DOUBLE AS y0, l_quantity + 5.0 AS x1, l_linenumber * 10.0::DOUBLE + 8 AS y1 FROM lineitem),
c AS (SELECT *, greatest(x0 - 2, 0.0) AS cx0, greatest(y0 - 2, 0.0) AS cy0, least(x1 + 2, 100.0) AS cx1, least(y1 + 2, 200.0) AS cy1 FROM b),
d AS (SELECT *, CASE WHEN cx1 - cx0 < 10 OR cy1 - cy0 < 10 THEN 20000.0 ELSE (cx1 - cx0) * (cy1 - cy0) END AS area FROM c)
SELECT l_orderkey, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(sum(area), 4) AS crop_area, round(max(x1 / 100), 6) AS right_edge FROM d GROUP BY l_orderkey""")
def bbox_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as boxes on a page of 100 by 200: union, crops and relative edges."""
    q, y = F.col("l_quantity"), F.col("l_linenumber") * F.lit(10.0)
    width, height = F.lit(100.0), F.lit(200.0)
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", geometry.box(q, y, q + 5.0, y + 8).alias("b"))
    c = geometry.crop(F.col("b"), width, height, 2.0)
    rows = rows.select("l_orderkey", "b.*", ((c["x1"] - c["x0"]) * (c["y1"] - c["y0"])).alias("area"), geometry.relative(F.col("b"), width, height)["x1"].alias("edge"))
    out = rows.groupBy("l_orderkey").agg(geometry.union_box("x0", "y0", "x1", "y1").alias("u"), F.round(F.sum("area"), 4).alias("crop_area"), F.round(F.max("edge"), 6).alias("right_edge"))
    return out.select("l_orderkey", "u.*", "crop_area", "right_edge")


@query("highlight_rects", """WITH c AS (SELECT unnest(['#ffd54f', '#81c784', '#64b5f6', '#e57373', '#ba68c8', '#4db6ac', '#ffb74d', '#a1887f']) AS colour, unnest(range(8)) AS i)
SELECT l_orderkey, l_linenumber % 2 AS page, colour, count(*) AS rects, round(min(l_quantity), 2) AS x0 FROM lineitem JOIN c ON l_linenumber % 8 = i GROUP BY ALL""")
def highlight_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("page"), fx.palette(F.col("l_linenumber")).alias("colour"), "l_quantity")
    return rows.groupBy("l_orderkey", "page", "colour").agg(F.count("*").alias("rects"), F.round(F.min("l_quantity"), 2).alias("x0"))


@query("font_fit", """SELECT p_partkey, round(CASE WHEN length(p_name) * 12.0::DOUBLE * 0.5 <= p_size THEN 12.0 ELSE greatest(6.0, 12.0::DOUBLE * p_size / (length(p_name) * 12.0::DOUBLE * 0.5)) END, 4) AS size FROM part""")
def font_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.round(fx.shrink_font(F.length("p_name"), F.lit(12.0), F.col("p_size")), 4).alias("size"))


@query("split_page_validation", """WITH want AS (SELECT DISTINCT conv_id, turn + (conv_id % 3) AS page FROM conversations), have AS (SELECT DISTINCT conv_id, turn AS page FROM conversations)
SELECT conv_id, string_agg(CASE WHEN h.page IS NOT NULL THEN CAST(w.page AS VARCHAR) END, ',' ORDER BY w.page) AS pages, count(*) FILTER (WHERE h.page IS NULL) AS warned FROM want w LEFT JOIN have h USING (conv_id, page) GROUP BY conv_id""")
def split_page_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that ask for pages (turns) the document lacks lose them with a warning."""
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("have"))
    want = F.transform("have", lambda t: t + F.col("conv_id") % 3)
    kept = F.array_sort(F.array_intersect(want, "have"))
    pages = F.nullif(F.array_join(F.transform(kept, lambda x: x.cast("string")), ","), F.lit(""))
    return rows.select("conv_id", pages.alias("pages"), F.size(F.array_except(want, "have")).cast("bigint").alias("warned"))


_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query("form_match_ladder", f"""WITH f AS (SELECT p_partkey, p_name AS field, CASE WHEN p_partkey % 5 = 0 THEN 'target ' || p_partkey END AS mapped, CASE WHEN p_partkey % 5 = 1 THEN 'alias-' || p_partkey WHEN p_partkey % 5 = 2 THEN 'Other Alias ' || p_partkey ELSE 'none ' || p_partkey END AS alias FROM part),
t AS (SELECT 'target ' || p_partkey AS target FROM part WHERE p_partkey % 5 = 0 UNION SELECT 'alias-' || p_partkey FROM part WHERE p_partkey % 5 = 1 UNION SELECT 'other_alias_' || p_partkey FROM part WHERE p_partkey % 5 = 2 UNION SELECT p_name FROM part WHERE p_size % 7 = 0 UNION SELECT upper(replace(p_name, ' ', '_')) FROM part WHERE p_size % 2 = 0),
g AS (SELECT min(p_partkey) AS k, field FROM f GROUP BY field), o AS (SELECT f.* FROM f JOIN g ON f.p_partkey = g.k), h AS (SELECT target, {_KEY.format("target")} AS k FROM t),
m AS (SELECT field, target, 0 AS rank FROM o JOIN t ON mapped = target UNION ALL SELECT field, target, 1 FROM o JOIN t ON alias = target UNION ALL SELECT field, target, 2 FROM o JOIN h ON {_KEY.format("alias")} = k
UNION ALL SELECT field, target, 3 FROM o JOIN t ON field = target UNION ALL SELECT field, target, 4 FROM o JOIN h ON {_KEY.format("field")} = k),
b AS (SELECT field, min(struct_pack(rank := rank, target := target)) AS x FROM m GROUP BY field)
SELECT o.field, x.target AS target, CASE x.rank WHEN 0 THEN 'map' WHEN 1 THEN 'alias' WHEN 2 THEN 'normalized alias' WHEN 3 THEN 'name' WHEN 4 THEN 'normalized name' END AS rule FROM o LEFT JOIN b USING (field)""")
def form_match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as data fields with maps and aliases, against form fields that are written in other ways; every rule has its turn."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 5
    own = p.groupBy(F.col("p_name").alias("field")).agg(F.min("p_partkey").alias("p_partkey"))
    alias = F.when(kind == 1, F.concat(F.lit("alias-"), key)).when(kind == 2, F.concat(F.lit("Other Alias "), key)).otherwise(F.concat(F.lit("none "), key))
    fields = own.select("field", F.when(kind == 0, F.concat(F.lit("target "), key)).alias("mapped"), F.array(alias).alias("aliases"))
    named = p.select(F.when(kind == 0, F.concat(F.lit("target "), key)).when(kind == 1, F.concat(F.lit("alias-"), key)).when(kind == 2, F.concat(F.lit("other_alias_"), key)).alias("target")).where("target is not null")
    targets = named.union(p.where("p_size % 7 = 0").select("p_name")).union(p.where("p_size % 2 = 0").select(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))).distinct()
    return forms.match(fields, targets)


@query("blank_label_lookup", f"""WITH {_WORDS}, bl AS (SELECT conv_id, turn, min(b) AS bx FROM x WHERE length(text) >= 8 GROUP BY ALL),
n AS (SELECT conv_id, turn, word, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY e DESC, word DESC) AS k FROM x JOIN bl USING (conv_id, turn) WHERE e <= bx)
SELECT conv_id, turn, string_agg(text, ' ' ORDER BY k DESC) AS label FROM n WHERE k <= 6 GROUP BY ALL""")
def blank_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first long word of a turn stands for a blank; its label is the six words before it."""
    w = words(spark, sf_dir)
    blanks = w.where(F.length("text") >= 8).groupBy("conv_id", "turn").agg(F.min("begin").alias("blank_x0")).withColumn("blank", F.lit(0))
    return forms.blank_labels(w.select("conv_id", "turn", "word", "text", F.col("end").alias("x1")), blanks, ["conv_id", "turn"]).select("conv_id", "turn", "label")


@query("phrase_scores", """WITH c AS (SELECT n_name AS phrase, r_name AS label FROM nation CROSS JOIN region UNION ALL SELECT p_name, p_brand || ' ' || p_type FROM part),
k AS (SELECT DISTINCT phrase, label, regexp_replace(lower(phrase), '[^a-z0-9]+', '', 'g') AS p, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS l, list_filter(regexp_extract_all(lower(phrase), '[0-9a-z]+'), lambda w: length(w) > 1 AND w NOT IN ('a', 'an', 'and', 'for', 'in', 'is', 'no', 'number', 'of', 'on', 'the', 'to', 'value')) AS ws, regexp_extract_all(lower(label), '[0-9a-z]+') AS hs FROM c)
SELECT phrase, label, round(CASE WHEN p = '' OR l = '' THEN 0.0 WHEN contains(l, p) OR contains(p, l) THEN 1.0 ELSE coalesce(len(list_filter(ws, lambda w: list_contains(hs, w))) / nullif(len(ws), 0), 0.0) END, 4) AS score FROM k""")
def phrase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "nation").crossJoin(load(spark, sf_dir, "region")).select(F.col("n_name").alias("phrase"), F.col("r_name").alias("label"))
    pairs = pairs.union(load(spark, sf_dir, "part").select("p_name", F.concat_ws(" ", "p_brand", "p_type"))).distinct()
    return pairs.select("phrase", "label", F.round(fx.phrase_score(F.col("phrase"), F.col("label")), 4).alias("score"))
