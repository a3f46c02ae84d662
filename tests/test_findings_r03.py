"""What a review of odd inputs and larger tables found."""

import random

from pyspark.sql import functions as F

from inkstrata.operators import adapters, extraction, locate, parsing, tables
from inkstrata.operators import schema as sc
from inkstrata.plans import engine_queries, layout_queries


def test_decision_sees_the_middle_of_a_long_text(spark):
    text = "first 12 " + "word " * 3000 + "who@where.net " + "word " * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = extraction.extract(docs, engine_queries.CONTACT, engine_queries.reading_model, extraction.Options(mode="multi", instances=3))
    assert {r.field: r.value for r in out.collect()} == {"email": "who@where.net", "number": "12", "first_word": "first", "address": None}


def anchored_lines(words):
    """Lines of one page's (text, x0, top, x1), word by word."""
    rows = []
    for w in sorted(words, key=lambda w: (w[2], w[1], w[3], w[0])):
        if not rows or abs(w[2] - rows[-1][0][2]) > parsing.ROW_TOLERANCE:
            rows.append([])
        rows[-1].append(w)
    lines = []
    for row in rows:
        last = None
        for w in sorted(row, key=lambda w: w[1]):
            if last is None or w[1] - last > parsing.WIDEST_GAP:
                lines.append([])
            lines[-1].append(w[0])
            last = w[3]
    return lines


def test_lines_go_on_over_batches_and_no_page_is_a_group_of_its_own(spark):
    rng = random.Random(3)
    pages = {(d, p): [(f"w{i}", float(rng.randrange(0, 300, 5)), float(rng.randrange(40)), 0.0) for i in range(n)] for (d, p), n in {(1, 0): 60, (1, 1): 1, (2, 0): 200, (3, 0): 7, (4, 5): 40}.items()}
    pages = {k: [(t, x, y, x + 9) for t, x, y, _ in ws] for k, ws in pages.items()}
    pages[5, 0] = [(f"w{i}", 30.0 * i, 0.0, 30.0 * i + 9) for i in range(50)]  # one row over several batches
    words = spark.createDataFrame([(*k, t, x, y, z, y + 9) for k, ws in pages.items() for t, x, y, z in ws], "doc_id long, page int, text string, x0 double, top double, x1 double, bottom double")
    lines = parsing.lines_of_words(words)
    assert "FlatMapGroups" not in lines._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {}
        for r in sorted(lines.collect(), key=lambda r: (r.doc_id, r.page, r.line, r.word)):
            of = got.setdefault((r.doc_id, r.page), [])
            assert (r.line, r.word) == ((len(of) - 1, len(of[-1])) if r.word else (len(of), 0))
            of.append([]) if r.word == 0 else None
            of[-1].append(r.text)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: anchored_lines(ws) for k, ws in pages.items()}


def test_an_answer_is_parsed_twice_however_many_fields_are_read(spark):
    rows = spark.createDataFrame([(1, '{"name": "a", "price": "$2,000.5", "tags": "one", "codes": ["(3)"]}'), (2, "sorry"), (3, '{"codes": "x", "large": "Yes"}'), (4, None)], "doc_id long, answer string")
    c = F.col("c")
    out = rows.select("doc_id", sc.coerce_answer(engine_queries.PART, F.col("answer")).alias("c")).select("doc_id", *[c["data"][n].alias(n) for n in engine_queries.PART.names], c["faults"].alias("faults"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2
    none = ["the answer is no object"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (1, "a", 2000.5, None, ["one"], None, [-3], []), (2, *[None] * 6, none), (3, None, None, None, None, True, None, ["name: missing", "price: missing", "codes: not a list"]), (4, *[None] * 6, none),
    ]


def test_exact_places_of_many_phrases_are_those_of_each_alone(spark):
    phrases = ["two  Words", "two words", "words", "$", "", "o t", "ΟΔΟΣ", "words two", "a\fb"]
    texts = ["One two words\ntwo\fwords, two WORDS", "", None, "ΟΔΟΣ and $ two\f\n\nwords", "a\fb a b", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for every in (False, True):
        found = locate.everywhere(docs, phrases, every, fuzzy=False)
        assert phrases[-2] not in found._jdf.queryExecution().analyzed().toString()  # phrases do not travel with each row
        want = [(d, p, s.first, s.last) for d, t in enumerate(texts) for p in phrases for s in locate.locate(locate.stream(t or ""), p, every, fuzzy=False)]
        assert sorted((r.doc_id, r.query, r.first_word, r.last_word) for r in found.collect()) == sorted(want) and want


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_table_cells_are_moved_once(spark, small):
    assert exchanges(layout_queries.table_records(spark, small)) == 1
    rows = [(1, 0, True, 0, "a"), (1, 1, True, 0, "late"), (1, 0, True, 1, "a"), (1, 2, False, 0, "x"), (1, 2, False, 1, "y"), (1, 2, False, 2, "z"), (1, 3, False, 0, None), (2, 1, False, 0, "k"), (3, 0, True, 2, None), (3, 1, False, 2, "q")]
    cells = spark.createDataFrame(rows, "doc_id long, row int, is_header boolean, col int, text string")
    got = tables.records(cells, ["doc_id"], ["a", "col_0", "col_2"]).orderBy("doc_id", "row").collect()
    assert [tuple(r) for r in got] == [(1, 2, "y", None, "z"), (1, 3, None, None, None), (2, 1, None, "k", None), (3, 1, None, None, "q")]


def test_rows_are_dealt_before_they_are_multiplied(spark, small):
    for q in (engine_queries.fill_plan, engine_queries.fill_unmapped, engine_queries.words_of_blocks, engine_queries.page_lines, layout_queries.word_block_spatial_join):
        assert "REPARTITION_BY_NUM" in q(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_calls_take_items_from_arrow_one_by_one(spark):
    def build():
        return lambda items: [1 / 0] if items == [None] else [items[0] * 2]

    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, None), (3, 2, "")], "doc_id int, instance long, question string")
    out = adapters.call(rows, build, "question", retries=1)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, 1, "aa", None), (2, 1, None, "ZeroDivisionError: division by zero"), (3, 2, "", None)]
