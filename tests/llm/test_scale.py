"""What the plans of the training-data operators move, and that nothing relies on one machine."""

import re
from pathlib import Path

import pytest

from inkstrata.llm import queries

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_token_counts", "op3_order_minhash", "op5_bpe_encode", "op6_pii", "op7_toxicity", "op9_license_scan"])
def test_row_wise_operators_do_not_shuffle_and_read_two_columns(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


def test_url_filter_reads_only_the_url(spark, small):
    plan = queries.QUERIES["op8_url_filter"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "url:string" in plan and not re.search(r"ReadSchema: struct<[^>]*html", plan)
    assert len(re.findall(r"FileScan parquet[^\n]*url", plan)) == 1  # the other scan made the counts of hosts, which are checkpointed


def test_no_local_checkpoints_or_rows_on_the_driver():
    source = "".join(p.read_text() for p in [*(ROOT / "inkstrata").rglob("*.py"), ROOT / "corpus_pipeline.py"])
    assert "localCheckpoint" not in source and ".rdd" not in source and "toPandas" not in source and ".collect()" not in source
