"""Operators on small hand-made tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstrata.functions import text as fx
from inkstrata.operators import adapters, documents, forms, geometry, locate, privacy, reports, rules, search, tables, trust, verification
from inkstrata.plans.workflow import compile_workflow
from inkstrata.sources import files
from inkstrata.sources.html import text_of
from inkstrata.streaming import ingest


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return row.select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (fx.squeeze, "  $1,234  Total ", "1234 total"), (fx.squeeze, None, None), (fx.squeeze, "", ""), (fx.plain, " A  $B ", "a  b"), (fx.scored, "5 % ", "5 "), (fx.key, "First-Name 2", "firstname2"),
        (fx.to_number, "(1,200.50)", -1200.5), (fx.to_number, "none", None), (fx.to_number, "$-3", -3.0), (fx.to_bool, " YES", True), (fx.to_bool, "0", False), (fx.to_bool, "maybe", None),
        (fx.unfence, "```json\n{}\n```", "{}"), (fx.base_name, "a/b\\c.pdf", "c.pdf"), (fx.mask, "abc", "a**"), (fx.mask, "a", "*"), (fx.mask, "", ""),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, fn(F.col("v")), v=value) == want


def test_text_of_double_has_no_exponent(spark):
    assert [one(spark, fx.text_of(F.col("v")), v=x) for x in (1234567890.0, 0.0005, 2.5)] == ["1234567890.0", "0.0005", "2.5"]


def test_candidates_agree(spark):
    v, src = F.col("v"), F.lit("the total is 12 euros")
    values = ["12", "12", "13", None]
    assert one(spark, trust.agreement(v), v=values) == 0.6667
    assert one(spark, trust.majority(v), v=values) == "12"
    assert one(spark, trust.consensus(v, trust.majority(v)), v=values) == 0.5
    assert one(spark, trust.trust_gate(v, src), v=values) is False
    assert one(spark, trust.trust_gate(v, src), v=["12", " 12"]) is True
    assert one(spark, trust.trust_gate(v, src), v=[None, None]) is False
    assert one(spark, trust.agreement(v), v=[None]) is None
    assert one(spark, trust.majority(v), v=["b", "a"]) == "b"  # of ties the earliest


def test_escalation_and_queue(spark):
    e = documents.escalation
    n = F.lit(None).cast("double")
    assert one(spark, e(F.col("c"), F.lit(1), n, n), c=5) == "too little text"
    assert one(spark, e(F.col("c"), F.lit(1), n, n), c=50) is None
    assert one(spark, e(F.col("c"), F.lit(1), F.lit(0.5), F.lit(0.0)), c=50) == "low confidence"
    rows = spark.createDataFrame([(1, i, f"f{i}", "v", 0.1 * i, True) for i in range(9)], "doc_id long, pos int, field string, value string, consensus double, found boolean")
    assert [r.field for r in verification.queue(rows).orderBy("rank").collect()] == ["f0", "f1", "f2", "f3", "f4"]


def box_words(*lines):
    """Words of lines (page, block, top, [(text, x0, x1, confidence)]) of a line height of 12."""
    return [{"text": t, "page": p, "block": b, "x0": float(a), "y0": float(top), "x1": float(z), "y1": top + 12.0, "confidence": c} for p, b, top, ws in lines for t, a, z, c in ws]


BILL = box_words(
    (0, 1, 72, [("Invoice", 72, 120, 0.99), ("from", 125, 155, 0.97), ("Acme", 160, 200, 0.93), ("Corp", 205, 240, 0.9)]), (0, 2, 100, [("Total:", 72, 110, 0.97), ("$1,234.56", 115, 180, 0.7)]),
    (1, 3, 72, [("Payment", 72, 130, 0.95), ("terms:", 135, 175, 0.94), ("Net", 180, 205, 0.96), ("30", 210, 228, 0.92)]),
)


def found(words, query, **options):
    doc = locate.Located(locate.stream_of(words, options.get("case_sensitive", False)))
    return [doc.place(s) | {"exact": s.exact, "ratio": s.ratio} for s in doc.locate(query, **options)]


def test_places_of_exact_matches():
    one = found(BILL, "Acme Corp")[0]
    assert one["box"] == {"x0": 160, "y0": 72, "x1": 240, "y1": 84} and one["confidence"] == 0.9 and len(one["rects"]) == 1 and one["exact"]
    assert found(BILL, "1234.56")[0]["confidence"] == 0.7 and found(BILL, "nowhere at all") == [] and found(BILL, "acme", case_sensitive=True, fuzzy=False) == []
    lines = found(BILL, "Corp Total:")[0]
    assert [r["box"]["x0"] for r in lines["rects"]] == [205, 72] and lines["blocks"] == [1, 2] and lines["box"]["x0"] == 72
    pages = found(BILL, "1234.56 Payment")[0]
    assert [r["page"] for r in pages["rects"]] == [0, 1] and pages["box"] is None and pages["page"] == 0 and pages["confidence"] == 0.7


def test_touching_words_near_words_and_hints():
    tight = box_words((0, 1, 72, [("No:", 72, 95, 0.9), ("INV", 100, 125, 0.95), ("-001", 126, 155, 0.85)]))
    assert [p["confidence"] for p in found(tight, "INV-001", fuzzy=False)] == [0.85]
    garbled = box_words((0, 1, 72, [("lnvoice", 72, 120, 0.7), ("INV-O01", 125, 180, 0.65)]))
    near = found(garbled, "INV-001")
    assert len(near) == 1 and not near[0]["exact"] and 0.8 <= near[0]["ratio"] < 1 and near[0]["confidence"] == 0.65 and found(garbled, "INV-001", fuzzy=False) == []
    twice = box_words((0, 1, 72, [("Acme", 72, 110, 0.9)]), (1, 2, 72, [("Acme", 72, 110, 0.8)]))
    assert found(twice, "Acme", hint=1)[0]["page"] == 1 and found(twice, "Acme")[0]["page"] == 0 and len(found(twice, "Acme", every=True)) == 2


def plain_locate(words, query, threshold=0.8, every=False):
    """The search by trying every window at every place."""
    from difflib import SequenceMatcher

    want = locate.normal(query)
    if not want or not words:
        return []
    doc, n = locate.Located(words), len(want.split())
    sizes = [n] + [n - 1] * (n > 1) + [min(len(words), n + 1)]
    exact, best, start = [], None, 0
    while start < len(words):
        end = None
        for size in sizes:
            if size < 1 or start + size > len(words):
                continue
            if doc.holds(start, start + size, want):
                a, b = doc.narrow(start, start + size, want)
                exact.append((a, b - 1, True))
                end = start + size
                break
            m = SequenceMatcher(None, want, doc.part(start, start + size))
            if m.quick_ratio() >= 0.5 and m.ratio() >= threshold and (best is None or m.ratio() > best[0]):
                best = (m.ratio(), start, start + size - 1)
        if end and not every:
            break
        start = end or start + 1
    return exact if every else exact[:1] or ([(best[1], best[2], False)] if best else [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "abc", "b", "cab", "a-", "xyz"]), max_size=9), st.lists(st.sampled_from(["ab", "abc", "b", "ca", "a-b", "xy"]), min_size=1, max_size=4), st.booleans(), st.data())
def test_locating_equals_trying_every_window(texts, query, every, data):
    words = [locate.Word(t, t, 0, 0, (10.0 * k, 0.0, 10.0 * k + (10 if data.draw(st.booleans()) else 5), 10.0), None) for k, t in enumerate(texts)]
    got = [(s.first, s.last, s.exact) for s in locate.locate(words, " ".join(query), every)]
    want = plain_locate(words, " ".join(query), every=every)
    assert got == want or (every and got and not got[0][2] and want == [])


def test_evidence_ladder():
    doc = locate.Located(locate.stream_of(BILL))
    pages = ["Invoice from Acme Corp Total: $1,234.56", "Payment terms: Net 30 and a table: 777-x"]
    kinds = lambda **k: [(e["source"], e["text"], e["page"]) for e in locate.attach(doc, pages, **k)]
    assert kinds(value="Acme Corp") == [("exact_block", "Acme Corp", 0)] and kinds(value="ACME Corp", hint_text="from Acme") == [("exact_block", "from Acme", 0)]
    assert kinds(value="x", composite=["Acme", "Net 30", "Acme", True, None]) == [("exact_block", "Acme", 0), ("exact_block", "Net 30", 1)]
    assert kinds(value="table: 777-x") == [("page_text", "table: 777-x", 1)] and kinds(value="zebra", hint_page=1) == [("unmatched", "zebra", 1)] and kinds(value=None) == []

    assert locate.read_score(doc, pages, [0.9, 0.8], "Acme Corp")["score"] == 0.9 and locate.read_score(doc, pages, [0.9, 0.8], "table: 777-x")["score"] == 0.8 and locate.read_score(doc, pages, [], "zebra")["method"] == "unmatched"


def test_search_in_documents(spark):
    docs = spark.createDataFrame([(1, "The cat sat.\fA cat"), (2, "concat sat"), (3, None)], "doc_id long, text string")
    hits = {(r.doc_id, r.kind, r.page, r.found) for r in locate.search_document(docs, ["cat sat"]).collect()}
    assert hits == {(1, "exact", 0, "cat sat."), (2, "exact", 0, "concat sat")}
    fuzzy = locate.search_document(docs, ["kat sat"], fuzzy=True).where("doc_id = 1").collect()
    assert [(r.kind, r.found) for r in fuzzy] == [("fuzzy", "cat sat.")]


@pytest.mark.parametrize("most", [1, 2, 100])
def test_first_hits_do_not_depend_on_the_number_of_passes(spark, most):
    docs = spark.createDataFrame([(1, "concat sat here"), (2, "a cat sat"), (3, "... !!"), (4, None), (5, "")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, "Cat sat"), (8, "!!"), (9, ""), (10, None), (11, "cat SAT")], "item_id long, phrase string")
    got = {(r.item_id, r.doc_id, r.place) for r in search.first_hits(docs, phrases, most=most).collect()}
    assert got == {(7, 1, 4), (7, 2, 3), (8, 3, 5), (11, 1, 4), (11, 2, 3)}


def test_evidence_and_dictionary(spark):
    docs = spark.createDataFrame([(1, "Paid by ACME Corp in Berlin"), (2, None), (3, "")], "doc_id long, text string")
    fields = spark.createDataFrame([(1, "name", "Acme Corp"), (1, "city", "Paris"), (2, "name", "x"), (3, "name", None)], "doc_id long, field string, value string")
    got = {(r.doc_id, r.field): r.source for r in locate.evidence(fields, docs).collect()}
    assert got == {(1, "name"): "exact_block", (1, "city"): "unmatched", (2, "name"): "unmatched"}
    found = locate.dictionary(docs, {"ACME": "A", "ACME Corp": "B", "Corp": "C"}).collect()
    assert [(r.entity, r.begin, r.end) for r in found] == [("B", 8, 17)]


def test_privacy_roundtrip(spark):
    text = "a@b.com and c@d.org then a@b.com"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = privacy.detect(docs)
    hidden = privacy.anonymize(docs, found, "pseudonymize")
    texts = {r.doc_id: r.text for r in hidden.collect()}
    assert texts == {1: "EMAIL_ADDRESS_001 and EMAIL_ADDRESS_002 then EMAIL_ADDRESS_001", 2: None, 3: ""}
    assert {r.doc_id: r.text for r in privacy.restore(hidden, privacy.mappings(found)).collect()}[1] == text
    assert {r.doc_id: r.risk for r in privacy.risk(docs, found).collect()} == {1: pytest.approx(0.05 + 0.5 * 21 / 32, abs=1e-4), 2: 0.0, 3: 0.0}
    with pytest.raises(ValueError):
        privacy.replacement("rot13", F.lit("x"), F.lit("y"))


def test_review_and_status(spark):
    rows = spark.createDataFrame([(1, 0.5, None, 0), (2, 0.9, "x", 2), (3, 0.9, "x", 0)], "id int, confidence double, name string, errors int")
    out = rules.review(rows, [rules.confidence_below(F.col("confidence"), 0.7), rules.fields_missing({"name": F.col("name")}), rules.has_errors(F.col("errors"))])
    assert {r.id: r.reasons for r in out.collect()} == {1: ["confidence below 0.70", "missing: name"], 2: ["2 validation errors"], 3: []}
    assert one(spark, rules.approved(F.col("v")), v=" Approved, fine") is True
    assert one(spark, rules.approved(F.col("v")), v=None) is False


def test_geometry(spark):
    b = geometry.box(F.lit(0.9), F.lit(-1.0), F.lit(0.1), F.lit(0.5))
    out = spark.range(1).select(geometry.absolute(b, F.lit(100.0), F.lit(200.0)).alias("b"), geometry.relative(geometry.box(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0)), F.lit(0.0), F.lit(5.0)).alias("r")).first()
    assert tuple(out.b) == pytest.approx((10.0, 0.0, 90.0, 100.0)) and tuple(out.r) == (1.0, 1.0, 2.0, 2.0)


def test_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, "name", True), (1, 0, 1, "age", True), (1, 1, 0, "Ann", False), (1, 1, 1, "30", False), (1, 1, 2, "x", False)], "t int, row int, col int, text string, is_header boolean")
    assert [tuple(r) for r in tables.records(cells, ["t"], ["name", "age", "col_2"]).collect()] == [(1, 1, "Ann", "30", "x")]
    assert tables.rows(cells, ["t"], header=True).first().texts == ["name", "age"]


def test_forms(spark):
    fields = spark.createDataFrame([("first_name", None, ["fname"]), ("Last Name", None, []), ("zip", "PLZ", []), ("none", None, [])], "field string, mapped string, aliases array<string>")
    targets = spark.createDataFrame([("FName",), ("last_name",), ("PLZ",), ("zip",)], "target string")
    got = {r.field: (r.target, r.rule) for r in forms.match(fields, targets).collect()}
    assert got == {"first_name": ("FName", "normalized alias"), "Last Name": ("last_name", "normalized name"), "zip": ("PLZ", "map"), "none": (None, None)}
    scores = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.9), (1, 1, 0, 1.0), (1, 1, 1, 0.7), (1, 2, 1, 0.5)], "doc_id long, field_pos int, blank_pos int, score double")
    assert {(r.field_pos, r.blank_pos) for r in forms.assign_blanks(scores).collect()} == {(0, 0), (1, 1)}


def test_quality_without_fields_present(spark):
    rows = spark.createDataFrame([(1, None, False, False, False, False)], "doc_id int, value string, evidence boolean, found boolean, gate boolean, corrected boolean")
    assert reports.quality(rows, "doc_id").first().score == 0.0


def test_adapter_failures_stay_in_their_row(spark):
    def build():
        def model(texts):
            if texts[0] == "bad":
                raise ValueError("no")
            return [t.upper() for t in texts]

        return model

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "doc_id long, text string")
    out = {(r.doc_id, r.instance): (r.output, r.error) for r in adapters.call(adapters.instances(rows, 2), build, "text", retries=2, wait=0.0).collect()}
    assert out[(1, 2)] == ("OK", None) and out[(2, 1)] == (None, "ValueError: no")


def test_workflow(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com"), (2, "nothing")], "doc_id long, text string")
    flow = compile_workflow("name: t\nsteps:\n  - step: extract\n    fields: {email: '[a-z]+@[a-z.]+'}\n  - step: review\n    required: [email]\n")
    assert {r.doc_id: r.needs_review for r in flow(docs).collect()} == {1: False, 2: True}
    for bad in ({"steps": [{"step": "fly"}]}, {"steps": [{"step": "keep", "wings": 2}]}, {"nam": 1}):
        with pytest.raises(ValueError):
            compile_workflow(bad)


def test_html_and_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><script>x<y</script><p>One &amp; two</p><p>three</p></html>")
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.bin").write_bytes(b"\xff")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["b.txt"] == "plain" and got["a.html"].strip() == "One & two\nthree" and "c.bin" not in got
    assert one(spark, text_of(F.col("v")), v="") == ""
    assert {r.kind for r in files.read_files(spark, str(tmp_path)).collect()} == {"html", "text", "unknown"}


def test_stream_is_exactly_once(spark, small, tmp_path):
    rows = ingest.documents(spark, f"{small}/documents.parquet").select("doc_id")
    for _ in range(2):
        ingest.run_once(rows, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{small}/documents.parquet").count()
