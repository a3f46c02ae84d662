"""Secret scans, token counts, fingerprints, byte-pair codes and licences against brute force."""

import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstrata.llm import bpe, bpe_codec, license_scan, order_minhash, secret_scan, token_counts
from inkstrata.llm.textvec import mix

VOCAB = bpe.vocabulary()


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- secrets --------------------------------------------------------------------------------


def scanned(texts, rules):
    return sorted((n, i, m.start(), m.end()) for n, p in rules.items() for i, t in enumerate(texts) for m in re.compile(p, re.ASCII).finditer(t or ""))


def indexed(texts, rules):
    out = secret_scan.Scanner(rules).scan(pa.array(range(len(texts))), pa.array(texts, pa.string()))
    return sorted((r["rule"], r["doc_id"], r["begin_pos"], r["end_pos"]) for r in out.to_pylist())


def test_secrets_equal_a_full_scan(spark, small):
    texts = [r.text for r in documents(spark, small).collect()]
    texts += ["AKIA" + "A1" * 8, "akia" + "A1" * 8, "PassWord : abcdefghij", "x ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", None, "", "AK", "IA" + "B" * 16]
    assert indexed(texts, secret_scan.RULES) == scanned(texts, secret_scan.RULES)


PATTERNS = ["abc", "ab+c", "(abc|bcd)a", "a?bcd", "[ab]cd?a", "(?i:Ab)cd", "a.c", "a{2,3}b", "(ab){2}", "(a|)bca", "b[^a]cd", "(?:ab|c)*da", "a(?=b)bc", "(abca|b)c", r"\bab", "[a-d]{3}", "(a|b)(c|d)(a|b)"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcdABé ", max_size=12), max_size=6), st.sampled_from(PATTERNS))
def test_trigram_query_never_loses_a_match(texts, pattern):
    assert indexed(texts, {"r": pattern}) == scanned(texts, {"r": pattern})


def test_rules_without_trigrams_scan_fully_and_empty_matches_are_refused(none):
    assert secret_scan.trigram_query("[a-z]+") is True and secret_scan.trigram_query(secret_scan.RULES["aws_access_key"]) is not True
    with pytest.raises(ValueError):
        secret_scan.secrets(none, {"r": "a*"})


def test_secrets_edge_cases(messy, none, make):
    assert secret_scan.secrets(messy).count() == 0 and secret_scan.secrets(none).count() == 0
    twice = make(["AKIA" + "A1" * 8] * 2, ids=[7, 7])
    assert [(r.doc_id, r.begin_pos) for r in secret_scan.secrets(twice).collect()] == [(7, 0), (7, 0)]


# --- tokens ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=VOCAB.ranks, special_tokens={})


def naive(word: bytes) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        ranks = [(VOCAB.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not ranks or min(ranks)[0] == 1 << 40:
            return parts
        i = min(ranks)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


WORDS = st.one_of(st.text(max_size=30), st.text("abt he'\n ", max_size=40), st.lists(st.sampled_from(["ing", "tion", "the", "ab", "aa", " "]), max_size=12).map("".join))


@settings(max_examples=150, deadline=None)
@given(WORDS)
def test_merging_and_encoding_equal_brute_force(text):
    word = text.encode()
    want = naive(word)
    assert VOCAB.merge(word) == want and VOCAB.count(word) == len(want)
    tokens, off = bpe_codec.Encoder(VOCAB).encode([text, ""])
    whole = [VOCAB.ranks[p] for w in VOCAB.words(text) for p in naive(w.encode())]
    assert tokens.tolist() == whole and off.tolist() == [0, len(whole), len(whole)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(WORDS.map(str.encode), st.binary(max_size=20), st.sampled_from([b"a" * n for n in (1, 2, 3, 63, 64, 65, 200)])), max_size=30))
def test_words_in_bulk_equal_words_one_by_one(words):
    for many, one in ((VOCAB.greedy_all, VOCAB.greedy), (VOCAB.merge_all, lambda w: [VOCAB.ranks[p] for p in naive(w)])):
        tokens, size = many(words)
        want = [one(w) for w in words]
        assert tokens.tolist() == [t for x in want for t in x] and size.tolist() == [len(x) for x in want]


def test_new_words_are_cut_and_merged_together(monkeypatch, reference):
    """Invented words, most of them new in every text, as in large inputs; one by one only where they are long."""
    rng, calls = random.Random(8), Counter()
    texts = [" ".join("".join(rng.choice("aeioubdhlnrstéß") for _ in range(rng.randrange(1, 14))) for _ in range(300)) + " " + "xyz" * 40 * (k % 2) for k in range(20)]
    for name in ("greedy", "merge"):
        monkeypatch.setattr(bpe.Vocabulary, name, lambda self, word, *rest, own=getattr(bpe.Vocabulary, name), name=name: calls.update([(name, len(word) > bpe.BULK_BYTES)]) or own(self, word, *rest))
    VOCAB.compatible(np.array([0]), np.array([0]))  # its tables merge every token once
    calls.clear()
    enc = bpe_codec.Encoder(VOCAB)
    tokens, off = enc.encode(texts)
    assert [tokens[a:b].tolist() for a, b in zip(off, off[1:])] == [reference.encode_ordinary(t) for t in texts]
    assert enc.seen > 5000 and enc.failed > 1000 and not calls["greedy", False] + calls["merge", False] and calls["greedy", True]


def test_counts_and_codes_equal_the_library(spark, small, reference):
    docs = documents(spark, small)
    want = {r.doc_id: reference.encode_ordinary(r.text) for r in docs.collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    coded = {r.doc_id: r for r in bpe_codec.encode(docs).collect()}
    assert counts == {k: len(v) for k, v in want.items()}
    assert {k: list(r.tokens) for k, r in coded.items()} == want and all(r.round_trip and r.n_tokens == len(r.tokens) for r in coded.values())


def test_compatible_pairs_are_those_of_encodings():
    rng = random.Random(4)
    pairs = [(rng.randrange(VOCAB.size), rng.randrange(VOCAB.size)) for _ in range(3000)]
    a, b = np.array(pairs).T
    want = [naive(VOCAB.tokens[x] + VOCAB.tokens[y]) == [VOCAB.tokens[x], VOCAB.tokens[y]] for x, y in pairs]
    assert VOCAB.compatible(a, b).tolist() == want


def test_a_vocabulary_without_a_byte_is_refused(tmp_path):
    import base64

    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(255)))
    with pytest.raises(ValueError, match="255"):
        bpe.Vocabulary(str(path))


def test_token_edge_cases(messy, none):
    counts = token_counts.token_counts(messy).collect()
    coded = bpe_codec.encode(messy)
    assert len(counts) == messy.count() and token_counts.token_counts(none).count() == 0 and bpe_codec.encode(none).count() == 0
    assert sorted((r.doc_id is None, r.n_tokens or 0) for r in counts) == sorted((r.doc_id is None, r.n_tokens or 0) for r in coded.collect())
    by = {r.doc_id: r for r in coded.collect()}
    assert by[1].tokens is None and by[1].n_tokens is None and by[1].round_trip is None and by[2].tokens == [] and all(r.round_trip for k, r in by.items() if k != 1)
    back = bpe_codec.decode(coded)
    assert rows(back) == rows(messy.select("doc_id", "text"))


# --- fingerprints ---------------------------------------------------------------------------


def brute_signature(text):
    k = order_minhash.K
    grams = [text[i : i + k] for i in range(max(len(text) - k + 1, 1))] if text else []
    seen, elements = Counter(), []
    for g in grams:
        h = order_minhash.kmers(pa.array([g]))[0][0]
        elements.append(mix(np.array([h]) ^ mix(np.array([seen[g]], np.uint64) + np.uint64(0x1D)))[0])
        seen[g] += 1
    out = []
    for r in range(order_minhash.ROWS if grams else 0):
        h = order_minhash.row_hash(np.array(elements), slice(r, r + 1))[0]
        at = sorted(sorted(range(len(h)), key=lambda i: h[i])[: order_minhash.TUPLE])
        s = np.array([r], np.uint64)
        for j in range(order_minhash.TUPLE):
            s = mix(s * np.uint64(0xD6E8FEB86659FD93) + (elements[at[j]] if j < len(at) else np.uint64(0)))
        out.append(int(s.view(np.int64)[0]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé ", max_size=40), min_size=1, max_size=4))
def test_signatures_equal_brute_force(texts):
    sig, n = order_minhash.signatures(pa.array(texts))
    want = [v for t in texts for v in brute_signature(t)]
    assert sig.view(np.int64).tolist() == want and n.tolist() == [max(len(t) - order_minhash.K + 1, 1) if t else 0 for t in texts]


def test_blocks_of_elements_do_not_matter():
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(3 * order_minhash._BLOCK + 17))
    assert order_minhash.signatures(pa.array([text]))[0].view(np.int64).tolist() == brute_signature(text)


def test_signatures_feel_order_and_edits(spark, make):
    r = random.Random(2)
    base = "".join(r.choice("abcdefghij ") for _ in range(2000))
    docs = make([base, base[:1000] + "Z" + base[1001:], base[1000:] + base[:1000], "other " * 300])
    f = order_minhash.fingerprints(docs)
    pairs = f.alias("x").where("doc_id = 0").crossJoin(f.select(F.col("doc_id").alias("o"), F.col("signature").alias("other"))).select("o", order_minhash.similarity("signature", "other").alias("s"))
    s = {r.o: r.s for r in pairs.collect()}
    assert s[0] == 1.0 and s[1] > 0.8 and s[2] < s[1] and s[3] < 0.2


def test_fingerprint_edge_cases(messy, none):
    out = order_minhash.fingerprints(messy)
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].signature is None and by[1].n_kmers is None and by[1].fingerprint is None and by[2].signature == [] and by[0].signature == by[5].signature if by[0].n_kmers > 5 else True
    assert out.count() == messy.count() and order_minhash.fingerprints(none).count() == 0


# --- licences -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark, small):
    return license_scan.fit(documents(spark, small))


def test_licences_equal_the_planted_lines(spark, small, model):
    docs = documents(spark, small)
    signs = {"MIT": "MIT License", "Apache-2.0": "Apache License", "GPL": "General Public License", "CC-BY-NC": "CC BY-NC", "proprietary": "All rights reserved"}
    want = sorted((r.doc_id, n, f) for r in docs.collect() for n, line in enumerate(r.text.split("\n")) for f, s in signs.items() if s in line)
    assert sorted((r.doc_id, r.paragraph, r.family) for r in license_scan.licenses(docs, model).collect()) == want


@pytest.mark.parametrize(
    "text,family",
    [
        ("This software is licensed under the MIT license", "MIT"), ("licensed under the apache license version 2.0", "Apache-2.0"), ("Released under the GNU General Public License version 3 or later.", "GPL"), ("Text is available under CC BY-SA 4.0.", "CC-BY"),
        ("Licensed under CC BY-NC 3.0.", "CC-BY-NC"), ("Licensed under the Mozilla Public License, v. 2.0.", "MPL"), ("A driving license is required.", None), ("The apache helicopter landed at the license office.", None), ("The general public was not amused.", None), ("", None),
    ],
)
def test_held_out_notices(model, text, family):
    assert [f for _, _, f, _, _ in license_scan.detect(model, pa.array([text]))] == ([family] if family else [])


def test_notice_in_a_long_line_is_found(model):
    text = "word " * 500 + "Released under the MIT License. " + "word " * 500
    assert [(r, line, f) for r, line, f, _, _ in license_scan.detect(model, pa.array(["x", text]))] == [(1, 0, "MIT")]


LONG = {f: max(license_scan.NOTICES[f], key=len) for f in ("MIT", "GPL", "BSD")}


@pytest.mark.parametrize("family", LONG)
@pytest.mark.parametrize("columns", [40, 72, 80])
def test_wrapped_notices_are_found_where_they_begin(model, family, columns):
    text = "An ordinary first line.\n\n" + textwrap.fill(LONG[family], columns) + "\n\nMore text."
    assert [(line, f) for _, line, f, _, _ in license_scan.detect(model, pa.array([text]))] == [(2, family)]


@pytest.mark.parametrize("family", LONG)
def test_long_notices_are_found_at_all_offsets_of_a_long_line(model, family):
    texts = ["word " * k + LONG[family] + " word" * 60 for k in range(20, 68)]
    assert [(r, f) for r, _, f, _, _ in license_scan.detect(model, pa.array(texts))] == [(r, family) for r in range(48)]


HELD_OUT = {
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "EPL": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the given address",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy or use it.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "BSL": "Distributed under the Boost Software License, Version 1.0. (See accompanying file.)",
    "CC-BY": "This article is licensed under a Creative Commons Attribution 4.0 International License",
}


@pytest.mark.parametrize("family", HELD_OUT)
def test_notices_in_comments_are_told_from_their_siblings(model, family):
    text = "int x;\n\n/*\n" + textwrap.fill(HELD_OUT[family], 60, initial_indent=" * ", subsequent_indent=" * ") + "\n */\nint main() { return 0; }"
    assert [f for _, _, f, _, _ in license_scan.detect(model, pa.array([text]))] == [family]


def brute_likeness(template, text, weight):
    best = 0.0
    for mask in range(1 << len(template)):
        part = [t for k, t in enumerate(template) if mask >> k & 1]
        it = iter(text)
        if all(x in it for x in part):
            best = max(best, sum(weight[x] for x in part))
    return best / sum(weight[x] for x in template)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.lists(st.sampled_from("abcd"), max_size=9))
def test_likeness_equals_enumeration(template, text):
    weight = {"a": 0.5, "b": 1.0, "c": 2.5, "d": 4.0}
    m = license_scan.Model(None, None, 1.0, 0.5, weight)
    assert m.likeness(template, text) == pytest.approx(brute_likeness(template, text, weight))


def test_confirmed_families_equal_all_comparisons(model):
    """Every notice and every pair of halves: the family of the greatest likeness, then weight, then the first."""
    every = [(f, t) for f, notices in license_scan._templates().items() for t in notices]
    texts = [t for _, t in every] + [a[: len(a) // 2] + b[len(b) // 2 :] for (_, a), (_, b) in zip(every, every[7:])]
    for own in texts:
        best = max(((round(model.likeness(t, own), 6), sum(model.rarity[w] for w in t), -k) for k, (_, t) in enumerate(every)))
        family, like, _ = license_scan.confirm(model, list(license_scan.NOTICES), own)
        assert (family, like) == (every[-best[2]][0], best[0]) if best[0] >= license_scan.CONFIRM else like < license_scan.CONFIRM


def test_sample_takes_the_least_hashes_once(spark, make, monkeypatch):
    taken = []
    monkeypatch.setattr(license_scan, "train", lambda texts: taken.append(texts.to_pylist()))
    texts = ["the same text"] * 500 + [f"text {k}" for k in range(40)] + [None, ""]
    license_scan.fit(make(texts), limit=10)
    hashes = {r.text: r.h for r in make(texts).where("length(text) > 0").select("text", F.xxhash64("text").alias("h")).collect()}
    assert taken == [sorted(hashes, key=hashes.get)[:10]]


def test_counts_and_calibration_are_of_all_lines(spark, make, model):
    """More texts than the sample has; every line and paragraph is in the counts, against plain loops."""
    r = random.Random(4)
    common = ["license", "software", "the", "terms", "public", "river", "stone", "apple", "cloud"]
    texts = ["\n".join(" ".join(r.choices(common, k=r.randint(1, 40))) for _ in range(4)) + f" n{k}" for k in range(2 * license_scan.NEGATIVE_DOCS)]
    docs = make([*texts, None, "", "\n \n", "Released under the MIT License."])
    lines = [set(license_scan._plain(s)) for t in [*texts, "Released under the MIT License."] for s in t.split("\n")]
    n, number = license_scan.line_counts(docs)
    assert n == len(lines) and all(number[w] == sum(w in own for own in lines) for w in number) and number["software"] > 1000
    loss, found = license_scan.calibration(docs, model)
    p = license_scan.paragraphs(pa.array(texts))
    z, raw = license_scan.scores(p, model.weights, model.bias).astype(float), bytes(p.words.buf)
    own = [{raw[s:e].decode() for s, e in zip(p.words.start[b:e_], p.words.end[b:e_])} for b, e_ in zip(p.begin, p.end)]
    notices = [set(t) for ts in license_scan._templates().values() for t in ts]
    clean = [all(sum(model.rarity[w] for w in t & o) < 0.7 * sum(model.rarity[w] for w in t) for t in notices) for o in own]
    assert (found.sum(1) == sum(clean)).all() and sum(clean) > 2000
    want = [-np.log(license_scan.softmax(z[clean] / t)[:, 0]).sum() for t in license_scan.TEMPERATURES]
    assert np.allclose(loss, want, rtol=1e-3, atol=1e-2)
    assert license_scan.fit_all(docs).rarity == license_scan.weights_of_words(n, number)


def test_the_whole_model_finds_the_planted_lines(spark, small):
    test_licences_equal_the_planted_lines(spark, small, license_scan.fit_all(documents(spark, small)))


def test_scores_equal_a_plain_sum(model):
    p = license_scan.paragraphs(pa.array(["one two three\nfour", "five " * 200]))
    one, two = license_scan._slots(p.words)
    for i, z in enumerate(license_scan.scores(p, model.weights, model.bias)):
        b, e = p.begin[i], p.end[i]
        f = np.concatenate([one[b:e], two[b : max(e - 1, b)]])
        assert np.allclose(z, model.weights[f].sum(0) / np.sqrt(len(f)) + model.bias, atol=1e-3)


def test_licence_edge_cases(messy, none, make, model):
    assert license_scan.licenses(messy, model).count() == 0 and license_scan.licenses(none, model).count() == 0
    assert license_scan.fit(none).threshold > 0
    twice = license_scan.licenses(make(["Released under the MIT License."] * 2, ids=[None, 3]), model).collect()
    assert sorted((r.doc_id or -1, r.family) for r in twice) == [(-1, "MIT"), (3, "MIT")]
