"""Workflows from configuration: named steps compiled to one chain of DataFrame transformations.

A workflow is a mapping ``{"name": ..., "steps": [{"step": name, **options}]}`` or
its YAML. Unknown steps and options are errors. Nothing runs until an action.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.operators import documents as dm
from inkstrata.operators import privacy, rules

STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(name: str):
    def add(fn):
        STEPS[name] = fn
        return fn

    return add


@step("parse_html")
def _parse_html(docs: DataFrame, column: str = "html") -> DataFrame:
    from inkstrata.sources.html import text_of

    return docs.withColumn("text", text_of(F.col(column)))


@step("extract")
def _extract(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One column for each field: the first match of its pattern, null if there is none."""
    return docs.withColumns({n: F.nullif(F.regexp_extract("text", p, 0), F.lit("")) for n, p in fields.items()})


@step("anonymize")
def _anonymize(docs: DataFrame, mode: str = "redact", reversible: bool = False) -> DataFrame:
    if reversible and mode != "pseudonymize":
        raise ValueError("only pseudonyms are reversible")
    return privacy.anonymize(docs, privacy.detect(docs), mode)


@step("review")
def _review(docs: DataFrame, required: list[str]) -> DataFrame:
    return rules.review(docs, [rules.fields_missing({n: F.col(n) for n in required})])


@step("escalate")
def _escalate(docs: DataFrame) -> DataFrame:
    chars = F.length(F.regexp_replace("text", "\\s", ""))
    return docs.withColumn("escalation", dm.escalation(chars, F.size(dm.pages_of(F.col("text"))), F.lit(None).cast("double"), F.lit(None).cast("double")))


@step("keep")
def _keep(docs: DataFrame, where: str) -> DataFrame:
    return docs.where(where)


def compile_workflow(config: dict | str) -> Callable[[DataFrame], DataFrame]:
    """The workflow as a function of a DataFrame."""
    if isinstance(config, str):
        import yaml

        config = yaml.safe_load(config)
    unknown = set(config) - {"name", "steps"}
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    chain = []
    for entry in config.get("steps", []):
        options = {k: v for k, v in entry.items() if k != "step"}
        if entry.get("step") not in STEPS:
            raise ValueError(f"unknown step: {entry.get('step')}")
        fn = STEPS[entry["step"]]
        wrong = set(options) - set(list(inspect.signature(fn).parameters)[1:])
        if wrong:
            raise ValueError(f"step {entry['step']} has no options {sorted(wrong)}")
        chain.append((fn, options))

    def run(docs: DataFrame) -> DataFrame:
        for fn, options in chain:
            docs = fn(docs, **options)
        return docs

    return run
