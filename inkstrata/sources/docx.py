"""Word documents with the standard library: text, comments, links, tracked changes and highlighted runs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
SCHEMA = "doc_id bigint, kind string, author string, text string, target string, error string"


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}delText"))


def annotations(content: bytes) -> list[tuple[str, str | None, str, str | None]]:
    """(kind, author, text, target) of paragraphs, comments, links, insertions, deletions and highlights, in this order of kinds."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        body = ET.fromstring(z.read("word/document.xml"))
        comments = ET.fromstring(z.read("word/comments.xml")) if "word/comments.xml" in names else None
        links = {}
        if "word/_rels/document.xml.rels" in names:
            links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("word/_rels/document.xml.rels")).iter(f"{_REL}Relationship")}
    out = [("paragraph", None, _text(p), None) for p in body.iter(f"{_W}p")]
    if comments is not None:
        out += [("comment", c.get(f"{_W}author"), _text(c), None) for c in comments.iter(f"{_W}comment")]
    out += [("link", None, _text(h), links.get(h.get(f"{_R}id"))) for h in body.iter(f"{_W}hyperlink")]
    for tag, kind in (("ins", "insertion"), ("del", "deletion")):
        out += [(kind, x.get(f"{_W}author"), _text(x), None) for x in body.iter(f"{_W}{tag}")]
    for run in body.iter(f"{_W}r"):
        mark = run.find(f"{_W}rPr/{_W}highlight")
        if mark is not None:
            out.append(("highlight", None, _text(run), mark.get(f"{_W}val")))
    return out


def read_annotations(files: DataFrame) -> DataFrame:
    """Annotations of the files (doc_id, content); a file that can't be read gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows += [(doc, *a, None) for a in annotations(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError) as e:
                    rows.append((doc, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "author", "text", "target", "error"])

    return files.select("doc_id", "content").mapInPandas(run, SCHEMA)
