"""The pipeline against a single-process version of its stages on whole lists of rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from inkstrata.llm import bpe, decontamination, pii, simhash_dedup, toxicity
from inkstrata.llm.textvec import Words
from tests.llm.test_model_operators import brute_groups, table


def test_run_equals_stages_on_lists(spark, small):
    import tiktoken

    docs, labels, bench = (table(spark, small, t) for t in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.fit(docs, labels)
    score, _ = toxicity.score_rows(model, Words(pa.array([t for _, t in rows])))
    rows = [r for r, s in zip(rows, score) if s < toxicity.THRESHOLD]
    groups, _, _ = brute_groups(rows)
    rows = [r for r in rows if groups.get(r[0], r[0]) == r[0]]
    left = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id", "left_semi")
    bad = {r.doc_id for r in decontamination.leaks(left, bench).collect()}
    rows = [r for r in rows if r[0] not in bad]
    vocab = bpe.vocabulary()
    encode = tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=vocab.ranks, special_tokens={}).encode_ordinary
    want = {}
    for i, text in rows:
        for _, kind, b, e, _ in reversed(pii.find(pa.array([text]), pii.trained())):
            text = f"{text[:b]}[{kind}]{text[e:]}"
        want[i] = encode(text)
    got = {r.doc_id: list(r.tokens) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_and_take_odd_rows(spark, small, messy, none):
    for start in (messy, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
            assert docs.columns == start.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert out.count() == docs.count() and {"doc_id", "tokens", "lang", "source"} <= set(out.columns)


def test_repeated_ids_keep_their_different_texts(spark, small, make):
    docs = make(["one two three four five", "quite another text of words", "one two three four five", None], [5, 5, 5, 5])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
    assert sorted(str(r.text) for r in docs.collect()) == ["None", "one two three four five", "quite another text of words"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 3


def test_links_of_a_large_cluster_are_whole_in_bounded_memory():
    """A cluster of 5,000 different near copies, as larger inputs have it, in the shard search of the second stage."""
    rng, n = np.random.default_rng(3), 5000
    bits = rng.integers(0, 2, (1, simhash_dedup.BITS), dtype=np.uint8) ^ (rng.random((n, simhash_dedup.BITS)) < 0.1).astype(np.uint8)
    grams = np.hstack([np.tile(np.arange(20, dtype=np.uint32), (n, 1)), 100 + np.arange(n, dtype=np.uint32)[:, None]])
    members = simhash_dedup.Members(np.arange(n), np.packbits(bits, axis=1).view(np.uint64), np.zeros((n, simhash_dedup.TABLES), np.int64), np.arange(n + 1) * 21, grams.ravel())
    links = simhash_dedup.Links()
    shard = simhash_dedup.Shard(0, 7, True, links)
    shard.parts.append(members)
    tracemalloc.start()
    shard.build()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = links.rows().to_pydict()
    near = np.zeros(n, int)
    for i, j in simhash_dedup.within(members.sig, members.sig, simhash_dedup.RADIUS):
        near += np.bincount(i[i != j], minlength=n)
    assert rows == {"cls": list(range(n)), "root": [0] * n, "links": near.tolist()} and near.min() > 4900 and peak < 150e6


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "pii", "bpe"]
