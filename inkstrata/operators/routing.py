"""Workflows chosen for each document by a classifier, and documents split into sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.functions.text import base_name, unfence
from inkstrata.operators import adapters

PEEK_CHARS, LEAST_TEXT, THRESHOLD = 2000, 50, 0.5
PAGE_CHARS = 3000


def head(text: Column, chars: int) -> Column:
    return F.left(text, F.lit(chars))


def head_and_tail(text: Column, chars: int = 8000) -> Column:
    """The text, or its two ends with a mark between them where it is longer than ``chars``."""
    half = chars // 2
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("\n...[middle left out]...\n"), F.right(text, F.lit(half))))


class Router:
    """Registered workflows; each is a function of a DataFrame of documents that gives doc_id, success, confidence, needs_review, error."""

    def __init__(self, threshold: float = THRESHOLD, peek: int = PEEK_CHARS):
        self.threshold, self.peek = threshold, peek
        self.flows: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}

    def register(self, name: str, flow: Callable[[DataFrame], DataFrame], description: str = "") -> None:
        if name in self.flows:
            raise ValueError(f"the workflow {name!r} is registered already")
        self.flows[name] = (flow, description)

    @classmethod
    def from_config(cls, config: dict | str, compile_flow: Callable) -> Router:
        """From a mapping or YAML with ``workflows``: name, description and workflow of each; ``compile_flow`` makes the functions."""
        if isinstance(config, str):
            import yaml

            config = yaml.safe_load(config)
        out = cls(config.get("threshold", THRESHOLD), config.get("peek_chars", PEEK_CHARS))
        for entry in config.get("workflows", []):
            out.register(entry["name"], compile_flow(entry["workflow"]), entry.get("description", ""))
        return out

    def prompts(self, docs: DataFrame) -> DataFrame:
        """doc_id, prompt (null where there is too little text) and whether the first page's image is to be shown instead."""
        listing = "\n".join(f"- {n}: {d or n}" for n, (_, d) in self.flows.items())
        begin = head(F.coalesce("text", F.lit("")), self.peek)
        enough = F.length(F.trim(begin)) >= LEAST_TEXT
        ask = F.concat(F.lit(f"Which of these kinds is the document?\n{listing}\nAnswer with JSON: workflow, confidence from 0 to 1, reason.\n\nThe document begins:\n"), begin)
        return docs.select("doc_id", F.when(enough, ask).alias("prompt"), (~enough).alias("by_image"))

    def classify(self, docs: DataFrame, build: Callable, see: Callable | None = None) -> DataFrame:
        """doc_id, workflow, confidence, reason. ``build`` makes the text model, ``see`` one that gets the content of documents without text."""
        if not self.flows:
            raise ValueError("no workflow is registered")
        asked = self.prompts(docs).withColumn("instance", F.lit(1))
        answers = adapters.call(asked.where("not by_image"), build, "prompt")
        blank = docs.join(asked.where("by_image").select("doc_id"), "doc_id", "left_semi")
        if see is not None and "content" in docs.columns:
            answers = answers.unionByName(adapters.call(blank.withColumn("instance", F.lit(1)), see, "content"))
        else:
            answers = answers.unionByName(blank.select("doc_id", F.lit(1).alias("instance"), F.lit(None).cast("string").alias("output"), F.lit("no text to classify by").alias("error")))
        parsed = F.from_json(unfence(F.col("output")), "workflow string, confidence double, reason string")
        rows = answers.select("doc_id", F.trim(parsed["workflow"]).alias("name"), F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(parsed["reason"], F.lit("")).alias("said"), F.when(F.col("error").isNotNull(), F.col("error")).when(parsed.isNull() | parsed["workflow"].isNull(), "the answer is no JSON").alias("error"))
        known, sure = F.col("name").isin(*self.flows), F.col("confidence") >= self.threshold
        why = (
            F.when(F.col("error").isNotNull(), F.concat(F.lit("classification failed: "), F.col("error")))
            .when(~F.coalesce(known, F.lit(False)), F.when(F.col("said") != "", F.col("said")).otherwise(F.concat(F.lit("no registered workflow: "), F.coalesce("name", F.lit("none")))))
            .when(~sure, F.format_string("%s, but confidence %.2f is below %s", "name", "confidence", F.lit(str(self.threshold))))
        )
        return rows.select("doc_id", F.when(why.isNull(), F.col("name")).alias("workflow"), F.when(F.col("error").isNotNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce(why, F.col("said")).alias("reason"))

    def route(self, docs: DataFrame, build: Callable, see: Callable | None = None) -> DataFrame:
        """Every document with its workflow and what that made of it; documents without one are kept with the reason.

        The classification costs calls: give ``docs`` whose answers may be made once, and write the result before using it twice.
        """
        decided = self.classify(docs, build, see)
        with_flow = docs.join(decided.withColumnRenamed("confidence", "sure"), "doc_id")
        out = None
        for name, (flow, _) in self.flows.items():
            part = flow(with_flow.where(F.col("workflow") == name).drop("workflow", "sure", "reason"))
            have = set(part.columns)
            pick = lambda c, t, d: (F.col(c).cast(t) if c in have else F.lit(d).cast(t)).alias(c)  # noqa: B023, E731
            part = part.select("doc_id", pick("success", "boolean", True), pick("confidence", "double", None), pick("needs_review", "boolean", False), pick("error", "string", None))
            out = part if out is None else out.unionByName(part)
        name = base_name(F.col("path")) if "path" in docs.columns else F.col("doc_id").cast("string")
        named = docs.select("doc_id", name.alias("file_name"))
        rows = decided.withColumnRenamed("confidence", "classification_confidence").join(out.withColumnRenamed("confidence", "extraction_confidence"), "doc_id", "left").join(named, "doc_id")
        return rows.select("doc_id", "file_name", "workflow", "classification_confidence", "reason", F.coalesce("success", F.lit(False)).alias("success"), "extraction_confidence", "needs_review", "error")


def routed_csv(routed: DataFrame) -> DataFrame:
    """The seven columns of the routed report as text."""
    two = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))).otherwise("")
    return routed.select(
        "file_name", F.coalesce("workflow", F.lit("unclassified")).alias("workflow"), two("classification_confidence").alias("classification_confidence"), F.initcap(F.col("success").cast("string")).alias("success"), two("extraction_confidence").alias("extraction_confidence"),
        F.coalesce(F.initcap(F.col("needs_review").cast("string")), F.lit("")).alias("needs_review"), F.when(F.col("success"), "").otherwise(F.coalesce("error", "reason", F.lit(""))).alias("error"),
    )


def partitions(routed: DataFrame) -> DataFrame:
    """Each row with the part of the report it is in: its workflow, ``unclassified``, and whether it failed there."""
    return routed.withColumn("part", F.coalesce("workflow", F.lit("unclassified"))).withColumn("failed", F.col("workflow").isNotNull() & ~F.col("success"))


# --- splitting ------------------------------------------------------------------------------


def split_prompt(pages: DataFrame, sections: dict[str, str], overlap: bool = True, rules: str = "", deep: bool = False) -> DataFrame:
    """doc_id and the question for sections. ``pages``: doc_id, page, text; at most ``PAGE_CHARS`` characters of each page are shown, as the reference of the answer are page numbers."""
    shown = F.concat(F.lit("=== Page "), F.col("page").cast("string"), F.lit(" ===\n"), head(F.coalesce("text", F.lit("")), PAGE_CHARS))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", shown.alias("s")))), lambda x: x["s"]), "\n\n")
    listing = "\n".join(f"- {n}: {d or n.replace('_', ' ')}" for n, d in sections.items())
    ask = f"\n\nAssign the pages to these sections:\n{listing}\n{rules or 'Each page goes where it fits best.'}\n" + ("A page may be in several sections." if overlap else "Each page is in exactly one section.")
    ask += " For each section also give confidence (high, medium or low) and evidence." if deep else ""
    return pages.groupBy("doc_id").agg(F.concat(body, F.lit(ask + '\nAnswer with JSON: {"sections": {name: {"pages": [numbers from 0]}}}.')).alias("prompt"), F.count("*").alias("total_pages"))


def sections_of(answers: DataFrame, pages: DataFrame, sections: list[str]) -> DataFrame:
    """doc_id, section, pages (sorted, of the document), confidence, evidence, warning, from answers (doc_id, output).

    A section's answer may be an object or a bare list; an answer that is no JSON gives empty sections; pages that the document lacks go with a warning.
    """
    whole = F.from_json(F.get_json_object(unfence(F.col("output")), "$.sections"), "map<string, string>")
    rows = answers.select("doc_id", whole.alias("m")).select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.try_element_at("m", F.lit(n)).alias("raw")) for n in sections])).alias("s")).select("doc_id", "s.*")
    bare = F.from_json("raw", "array<int>")
    full = F.from_json("raw", "pages array<int>, confidence string, evidence string")
    is_list = F.startswith(F.trim("raw"), F.lit("["))
    none = F.array().cast("array<int>")
    asked = F.coalesce(F.when(is_list, bare).otherwise(full["pages"]), none)
    have = pages.groupBy("doc_id").agg(F.collect_set(F.col("page").cast("int")).alias("have"))
    rows = rows.select("doc_id", "section", asked.alias("asked"), F.coalesce(F.when(~is_list, full["confidence"]), F.lit("high")).alias("confidence"), F.coalesce(F.when(~is_list, full["evidence"]), F.lit("")).alias("evidence")).join(have, "doc_id", "left")
    gone = F.array_except("asked", F.coalesce("have", none))
    kept = F.array_sort(F.filter("asked", lambda p: F.array_contains(F.coalesce(F.col("have"), none), p)))
    warning = F.when(F.size(gone) > 0, F.concat(F.lit("section "), F.col("section"), F.lit(": no pages "), F.array_join(gone.cast("array<string>"), ", ")))
    return rows.select("doc_id", "section", kept.alias("pages"), "confidence", "evidence", warning.alias("warning"))


def split_documents(pages: DataFrame, sections: dict[str, str], build: Callable, **options) -> DataFrame:
    """The sections of every document, by a model."""
    asked = split_prompt(pages, sections, **options).withColumn("instance", F.lit(1))
    return sections_of(adapters.call(asked, build, "prompt").where("error is null"), pages, list(sections))
