"""What parsers give, as tables: words to lines and blocks, layout labels, recognised words, answers of reading services.

Readers of file formats and services are adapters (``READERS``); everything
after their answer is done here over rows. Boxes have their origin at the top
left; ``page`` counts from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from inkstrata.errors import ParsingError
from inkstrata.operators.documents import is_weak
from inkstrata.operators.geometry import box

#: Words whose tops differ by at most this from the first of a row are in the row; wider gaps than the second part a row into lines.
ROW_TOLERANCE, WIDEST_GAP = 3.0, 18.0
LOW_CONFIDENCE = 60.0
POINTS_PER_INCH = 72.0
#: Label of a layout model -> type of block; any other is text.
LABELS = {
    "title": "title", "section_header": "title", "text": "text", "paragraph": "paragraph", "list_item": "list_item", "picture": "image", "chart": "image", "formula": "formula",
    "page_header": "header", "page_footer": "footer", "caption": "text", "footnote": "text", "code": "text", "reference": "text",
}
LINE_SCHEMA = "doc_id bigint, page int, line int, word int, text string, x0 double, top double, x1 double, bottom double"


# --- native words ---------------------------------------------------------------------------


def _changes(c: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal."""
    v, none = c.fill_null(0).to_numpy(), c.is_null().to_numpy()
    return (v[1:] != v[:-1]) | (none[1:] != none[:-1])


def _rows_of_tops(page: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Number of each word's row, counted over all pages, of words sorted by page and top."""
    out, row, last, anchor = [], -1, None, 0.0
    for p, t in zip(page.tolist(), top.tolist()):
        if p != last or abs(t - anchor) > ROW_TOLERANCE:
            row, anchor, last = row + 1, t, p
        out.append(row)
    return np.array(out, dtype=np.int64)


def lines_of_words(words: DataFrame) -> DataFrame:
    """Lines of a page's words (doc_id, page, text, x0, top, x1, bottom).

    A row is anchored to its first word, so rows are found one after another, in
    one pass over the sorted words of many pages. Only the row that a batch
    breaks off is kept for the next one.
    """
    keys, order = ["doc_id", "page"], ["top", "x0", "x1", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, done, lines = None, None, 0  # words of the open row, the page of the last closed row, and its lines so far

        def close(t: pa.Table, end: int, row: np.ndarray, page: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal done, lines
            row, page = row[:end], page[:end]
            x0, x1 = (t[c].to_numpy()[:end] for c in ("x0", "x1"))
            at = np.lexsort((x0, row))
            row, page, x0, x1 = row[at], page[at], x0[at], x1[at]
            new = np.ones(end, bool)
            new[1:] = (row[1:] != row[:-1]) | (x0[1:] - x1[:-1] > WIDEST_GAP)
            number, first = np.cumsum(new) - 1, np.searchsorted(page, np.arange(page[-1] + 1))
            line = number - number[first][page]
            key = tuple(t[c][0].as_py() for c in keys)
            line[page == 0] += lines if key == done else 0
            starts = np.flatnonzero(new)
            word = np.arange(end) - starts[number]
            done, lines = tuple(t[c][end - 1].as_py() for c in keys), int(line[-1]) + 1
            out = t.slice(0, end).take(pa.array(at))
            cols = {"doc_id": out["doc_id"], "page": out["page"], "line": pa.array(line, pa.int32()), "word": pa.array(word, pa.int32()), **{c: out[c] for c in ("text", "x0", "top", "x1", "bottom")}}
            yield from pa.table(cols).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t])
            page = np.concatenate([[0], np.cumsum(_changes(t["doc_id"]) | _changes(t["page"]))])
            row = _rows_of_tops(page, t["top"].to_numpy())
            end = int(np.searchsorted(row, row[-1]))
            if end:
                yield from close(t, end, row, page)
            kept = t.slice(end)
        if kept is not None:
            zero = np.zeros(len(kept), dtype=np.int64)
            yield from close(kept, len(kept), zero, zero)

    flat = words.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page"), "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")])
    return flat.repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in order]).mapInArrow(run, LINE_SCHEMA)


def blocks_of_lines(lines: DataFrame, confidence: str | None = None) -> DataFrame:
    """One block for each line: its text, the box around its words, and their mean confidence if there is a column of it."""
    word = F.struct("word", "text", F.col("x0"), F.col("top").alias("y0"), F.col("x1"), F.col("bottom").alias("y1"), (F.col(confidence) if confidence else F.lit(None).cast("double")).alias("confidence"))
    return lines.groupBy("doc_id", "page", F.col("line").alias("block")).agg(
        F.lit("text").alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"),
        box(F.min("x0"), F.min("top"), F.max("x1"), F.max("bottom")).alias("box"), (F.avg(confidence) if confidence else F.lit(None).cast("double")).alias("confidence"), F.array_sort(F.collect_list(word)).alias("words"),
    )


def image_blocks(images: DataFrame) -> DataFrame:
    """Blocks without text for the pictures of a page (doc_id, page, block, x0, top, x1, bottom)."""
    return images.select("doc_id", "page", "block", F.lit("image").alias("type"), F.lit("").alias("text"), box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")).alias("box"))


def raw_text(pages: DataFrame) -> DataFrame:
    """doc_id and the texts of its pages in order, parted by blank lines."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n\n").alias("raw_text"), F.count("*").alias("pages"))


# --- recognised words -----------------------------------------------------------------------


def recognised_lines(rows: DataFrame, dpi: int = 200) -> DataFrame:
    """Lines of an OCR engine's word rows (doc_id, page, item, block_num, par_num, line_num, text, conf, left, top, width, height).

    Rows without text or of negative confidence are other levels; confidences become shares, pixels points.
    """
    scale = POINTS_PER_INCH / dpi
    words = rows.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= 0))
    px = lambda c: F.col(c) * F.lit(scale)
    words = words.select("doc_id", "page", "item", "block_num", "par_num", "line_num", F.trim("text").alias("text"), (F.col("conf") / 100).alias("confidence"), px("left").alias("x0"), px("top").alias("top"), ((F.col("left") + F.col("width")) * scale).alias("x1"), ((F.col("top") + F.col("height")) * scale).alias("bottom"))
    key = F.struct("block_num", "par_num", "line_num")
    first = F.min("item").over(Window.partitionBy("doc_id", "page", "block_num", "par_num", "line_num"))
    lines = words.withColumn("first", first).withColumn("line", F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("first", key)) - 1)
    return lines.withColumn("word", F.row_number().over(Window.partitionBy("doc_id", "page", "line").orderBy("item")) - 1).select("doc_id", "page", "line", "word", "text", "x0", "top", "x1", "bottom", "confidence")


def recognition_quality(rows: DataFrame) -> DataFrame:
    """doc_id, mean confidence (percent), share of weak words and number of words of an OCR engine's word rows."""
    words = rows.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= 0))
    return words.groupBy("doc_id").agg(F.avg("conf").alias("mean_confidence"), F.avg((F.col("conf") < LOW_CONFIDENCE).cast("double")).alias("low_share"), F.count("*").alias("words"))


def with_recognised(native: DataFrame, read: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, n_text_blocks, has_image, ...) of which the weak ones give way to what OCR read (doc_id, page, text)."""
    weak = native.withColumn("weak", F.coalesce(is_weak(F.col("text"), F.col("n_text_blocks"), F.col("has_image")), F.lit(True)))
    both = weak.join(read.select("doc_id", "page", F.col("text").alias("read")), ["doc_id", "page"], "left")
    use = F.col("weak") & F.col("read").isNotNull()
    return both.withColumn("text", F.when(use, F.col("read")).otherwise(F.col("text"))).withColumn("source", F.when(use, "ocr").otherwise("native")).drop("read")


# --- layout models --------------------------------------------------------------------------


def block_type(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), label), F.lit("text"))


def flipped(b: Column, origin: Column, height: Column) -> Column:
    """A box with its origin at the top; ``origin`` BOTTOMLEFT counts from the bottom."""
    return F.when(origin == "BOTTOMLEFT", box(b["x0"], height - b["y1"], b["x1"], height - b["y0"])).otherwise(b)


def polygon_box(polygon: Column, scale: Column | float = 1.0) -> Column:
    """The box around a flat list of x and y; null for fewer than two points."""
    xs = F.filter(polygon, lambda _, i: i % 2 == 0)
    ys = F.filter(polygon, lambda _, i: i % 2 == 1)
    k = F.lit(scale) if isinstance(scale, float) else scale
    return F.when(F.size(polygon) >= 4, box(F.array_min(xs) * k, F.array_min(ys) * k, F.array_max(xs) * k, F.array_max(ys) * k))


def layout_blocks(items: DataFrame) -> DataFrame:
    """Blocks of a layout model's items (doc_id, page, item, label, text, box, origin, height); tables and blank items other than pictures are left out."""
    rows = items.where("label <> 'table'").withColumn("type", block_type(F.col("label"))).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    return rows.where((F.col("text") != "") | (F.col("type") == "image")).select("doc_id", "page", F.col("item").alias("block"), "type", "text", flipped(F.col("box"), F.col("origin"), F.coalesce("height", F.lit(842.0))).alias("box"))


def harvested_words(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Recognised words of a layout model's page cells (doc_id, nth, cell, text, from_ocr, confidence, box), by the place of their page.

    ``pages``: doc_id, page. Where there are not as many pages of cells as pages nothing can be matched, and nothing is.
    """
    numbered = pages.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1)
    have, given = pages.groupBy("doc_id").agg(F.count("*").alias("have")), cells.groupBy("doc_id").agg((F.max("nth") + 1).alias("given"))
    fit = have.join(given, "doc_id").where("have = given").select("doc_id")
    good = cells.where(F.col("from_ocr") & F.col("confidence").isNotNull() & (F.trim("text") != "")).join(fit, "doc_id", "left_semi")
    return good.join(numbered, ["doc_id", "nth"]).select("doc_id", "page", "cell", F.trim("text").alias("text"), "confidence", "box")


def attach_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block, type, box) with the words (doc_id, page, cell, text, confidence, box) whose centre they hold.

    A word belongs to the first such block and to no other; a block's confidence is the mean of its words', null without any.
    """
    w = words.where("box is not null").select("doc_id", "page", "cell", F.col("text").alias("word"), F.col("confidence").alias("sure"), ((F.col("box.x0") + F.col("box.x1")) / 2).alias("cx"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("cy"))
    b = blocks.where("box is not null and type <> 'image'").select("doc_id", "page", "block", "box")
    inside = w.join(b, ["doc_id", "page"]).where((F.col("cx") >= F.col("box.x0")) & (F.col("cx") <= F.col("box.x1")) & (F.col("cy") >= F.col("box.y0")) & (F.col("cy") <= F.col("box.y1")))
    own = inside.groupBy("doc_id", "page", "cell", "word", "sure").agg(F.min("block").alias("block"))
    sums = own.groupBy("doc_id", "page", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "word"))), lambda x: x["word"]).alias("words"), F.avg("sure").alias("confidence"))
    return blocks.drop("words", "confidence").join(sums, ["doc_id", "page", "block"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


# --- answers of services --------------------------------------------------------------------


def lines_by_spans(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line, text, spans: array of offset and length) with the words (doc_id, page, offset, text, confidence) whose offset is in a span.

    The line's confidence is the mean of its words'; null without any.
    """
    parts = lines.select("doc_id", "page", "line", F.explode("spans").alias("s")).select("doc_id", "page", "line", F.col("s.offset").alias("a"), (F.col("s.offset") + F.col("s.length")).alias("z"))
    hit = parts.join(words.select("doc_id", "page", "offset", F.col("text").alias("word"), F.col("confidence").alias("sure")), ["doc_id", "page"]).where("offset >= a and offset < z").select("doc_id", "page", "line", "offset", "word", "sure").distinct()
    sums = hit.groupBy("doc_id", "page", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "word"))), lambda x: x["word"]).alias("words"), F.avg("sure").alias("confidence"))
    return lines.drop("words", "confidence").join(sums, ["doc_id", "page", "line"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def unit_scale(unit: Column) -> Column:
    """Points per unit of a service that measures in inches; pixels stay pixels."""
    return F.when(F.coalesce(unit, F.lit("inch")) == "inch", F.lit(POINTS_PER_INCH)).otherwise(F.lit(1.0))


def lines_by_children(items: DataFrame) -> DataFrame:
    """Lines of a response of items (doc_id, page, id, type, text, confidence, children: array of ids), each with its words.

    Confidences come in percent; a line's is the mean of its words', else its own.
    """
    lines = items.where("type = 'LINE'").select("doc_id", "page", "id", "text", (F.col("confidence") / 100).alias("own"), F.posexplode_outer("children").alias("nth", "child"))
    words = items.where("type = 'WORD'").select("doc_id", "page", F.col("id").alias("child"), F.col("text").alias("word"), (F.col("confidence") / 100).alias("sure"))
    rows = lines.join(words, ["doc_id", "page", "child"], "left")
    return rows.groupBy("doc_id", "page", "id", "text").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("nth", "word")))), lambda x: x["word"]).alias("words"), F.coalesce(F.avg("sure"), F.max("own")).alias("confidence"))


def anchor_range(segments: Column) -> Column:
    """struct<a, z> around the segments (array of start and end) of an anchor; null without any. A missing start is 0."""
    starts = F.transform(segments, lambda s: F.coalesce(s["start"], F.lit(0)))
    return F.when(F.size(segments) > 0, F.struct(F.array_min(starts).alias("a"), F.array_max(F.transform(segments, lambda s: s["end"])).alias("z")))


def anchor_text(text: Column, segments: Column) -> Column:
    """The pieces of a text that an anchor names, one after another."""
    part = lambda s: F.substring(text, F.coalesce(s["start"], F.lit(0)) + 1, s["end"] - F.coalesce(s["start"], F.lit(0)))
    return F.array_join(F.transform(segments, part), "")


def lines_by_anchors(docs: DataFrame, lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line, segments, confidence) of a text (doc_id, text), with the tokens (doc_id, page, token, segments, confidence) that begin in them.

    Lines and tokens without segments are left out; a line's confidence is the mean of its tokens', else its own.
    """
    l = lines.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").select("doc_id", "page", "line", F.trim(anchor_text(F.col("body"), F.col("segments"))).alias("text"), anchor_range(F.col("segments")).alias("r"), F.col("confidence").alias("own")).where("r is not null")
    t = tokens.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").select("doc_id", "page", "token", F.trim(anchor_text(F.col("body"), F.col("segments"))).alias("word"), anchor_range(F.col("segments")).alias("s"), F.col("confidence").alias("sure")).where("s is not null")
    hit = l.select("doc_id", "page", "line", "r").join(t, ["doc_id", "page"]).where("s.a >= r.a and s.a < r.z")
    sums = hit.groupBy("doc_id", "page", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("s.a", "token", "word"))), lambda x: x["word"]).alias("words"), F.avg("sure").alias("mean"))
    return l.drop("r").join(sums, ["doc_id", "page", "line"], "left").select("doc_id", "page", "line", "text", F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.coalesce("mean", "own").alias("confidence"))


def vertices_box(vertices: Column, normalized: Column, width: Column, height: Column) -> Column:
    """The box around vertices (array of x and y) in pixels, else around shares of the page; missing coordinates are 0."""
    at = lambda v, k: F.transform(v, lambda p: F.coalesce(p[k], F.lit(0.0)))
    whole = lambda v, w, h: box(F.array_min(at(v, "x")) * w, F.array_min(at(v, "y")) * h, F.array_max(at(v, "x")) * w, F.array_max(at(v, "y")) * h)
    return F.when(F.size(vertices) > 0, whole(vertices, F.lit(1.0), F.lit(1.0))).when(F.size(normalized) > 0, whole(normalized, width, height))


# --- images ---------------------------------------------------------------------------------


def _pixels(b: bytes | None) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG, GIF, BMP or JPEG."""
    if not b:
        return None, None
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
    if b[:2] == b"BM" and len(b) >= 26:
        return int.from_bytes(b[18:22], "little"), abs(int.from_bytes(b[22:26], "little", signed=True))
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b) and b[at] == 0xFF:
            mark, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
            at += 2 + size
    return None, None


@pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Pixels of an image from its header; nulls if it has none that is known."""
    sizes = [_pixels(None if c is None else bytes(c)) for c in content]
    return pd.DataFrame({"width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32")})


def image_pages(files: DataFrame) -> DataFrame:
    """One page in pixels for each image file (doc_id, content); without a known header the page has no size."""
    return files.select("doc_id", F.lit(0).alias("page"), image_size("content").alias("s")).select("doc_id", "page", F.col("s.width").cast("double").alias("width"), F.col("s.height").cast("double").alias("height"), F.lit("px").alias("unit"), F.lit("").alias("text"))


def grayscale(image):
    """Luminance of an array of height, width and three colours; other arrays stay."""
    import numpy as np

    return image if image.ndim == 2 else (image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def threshold(image, level: int = 128):
    import numpy as np

    return np.where(grayscale(image) > level, 255, 0).astype(np.uint8)


def denoise(image, size: int = 3):
    """The median of each pixel's square; edges repeat."""
    import numpy as np

    pad = np.pad(grayscale(image), size // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(pad, (size, size)), axis=(2, 3)).astype(np.uint8)


def rotated(image, quarters: int):
    """A page turned back by quarters of a circle, as an orientation detector asks for."""
    import numpy as np

    return np.rot90(image, -quarters % 4)


CLEANING: dict[str, Callable] = {"grayscale": grayscale, "denoise": denoise, "threshold": threshold}


def preprocess(image, steps: tuple[str, ...] = ("grayscale", "denoise", "threshold")):
    """The steps one after another; an unknown name is an error."""
    for s in steps:
        if s not in CLEANING:
            raise ParsingError(f"unknown step: {s}")
        image = CLEANING[s](image)
    return image


# --- readers --------------------------------------------------------------------------------

#: Name -> options that it takes. What a reader does with them is the adapter's.
READERS: dict[str, tuple[str, ...]] = {
    "native-pdf": (), "ocr": ("languages", "dpi", "preprocess"), "smart": ("languages", "dpi", "min_text_length"), "layout": (), "markdown": (), "azure-di": ("endpoint", "key", "model"), "textract": ("region", "dpi"), "google-docai": ("project", "location", "processor_id"),
}


def reader(spec: str | dict | None, kind: str, auto: bool = False) -> dict | None:
    """Name and options of the reader for a kind of source; None if the text needs none.

    ``spec``: a name, a mapping with ``type``, None or "none" for no reader, "auto" to choose by kind: none for text and mail, OCR for
    images, the native reader for PDF (``smart`` when extraction is automatic), the layout model for office files and sheets.
    """
    if spec is None or spec == "none":
        return None
    options = {k: v for k, v in spec.items() if k != "type"} if isinstance(spec, dict) else {}
    name = spec.get("type", "auto") if isinstance(spec, dict) else spec
    if name == "auto":
        if kind in ("text", "email", "html"):
            return None
        chosen = {"image": "ocr", "pdf": "smart" if auto else "native-pdf", "office": "layout", "docx": "layout", "spreadsheet": "layout"}.get(kind)
        if chosen is None:
            raise ParsingError(f"no reader for the kind {kind!r}")
        return {"type": chosen}
    if name not in READERS:
        raise ParsingError(f"unknown reader: {name!r}")
    wrong = set(options) - set(READERS[name])
    if wrong:
        raise ParsingError(f"the reader {name} has no options {sorted(wrong)}")
    return {"type": name, **options}


def export_reader(spec: dict | None) -> str | dict:
    """A reader as a configuration names it: only its name where it has no options."""
    if spec is None:
        return "none"
    return spec["type"] if len(spec) == 1 else dict(spec)


def readerless_fault(kind: Column, extraction: str) -> Column:
    """Why a source can't be used without a reader; null if it can: images and PDF for models that see, text and mail for the others."""
    fit = kind.isin("pdf", "image") if extraction in ("vision", "hybrid") else kind.isin("text", "email", "html")
    return F.when(~F.coalesce(fit, F.lit(False)), F.concat(F.lit(f"{extraction} extraction without a reader does not take "), F.coalesce(kind, F.lit("unknown")), F.lit(" files")))


PAGE_SCHEMA = "doc_id bigint, page int, text string, width double, height double, error string"


def read_pages(files: DataFrame, build: Callable[[], Callable[[bytes], list[tuple[str, float | None, float | None]]]]) -> DataFrame:
    """Pages of files (doc_id, content) by a reader that is built once in each worker; a file that fails gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = build()
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows += [(doc, n, text, w, h, None) for n, (text, w, h) in enumerate(read(bytes(content)))]
                except Exception as e:  # noqa: BLE001 - any failure of a reader is a row's error
                    rows.append((doc, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "width", "height", "error"]).astype({"page": "Int32", "width": "Float64", "height": "Float64"})

    return files.select("doc_id", "content").mapInPandas(run, PAGE_SCHEMA)


def markdown_pages(files: DataFrame, build: Callable) -> DataFrame:
    """The same for a reader that gives one stripped Markdown text: one page of one block."""
    return read_pages(files, lambda: (lambda convert: lambda content: [(convert(content).strip(), None, None)])(build()))
