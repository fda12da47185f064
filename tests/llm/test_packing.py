import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettersift.llm import packing, tokens


@pytest.fixture(scope="module")
def slow_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: encoder.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(spark, sf, slow_encoder):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert tokens.encode(r.text) == slow_encoder(r.text)
    rng = random.Random(6)
    alphabet = [*"ab1 .,'\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​᠎　é中🙂sSt!", "'s", "'ll", "  ", "\n\n", " \n", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(15)))
        assert tokens.encode(text) == slow_encoder(text), repr(text)
    assert tokens.encode(None) == tokens.encode("") == []
    assert tokens.encode("a <|endoftext|> b") == slow_encoder("a <|endoftext|> b") == [64, 220, 50256, 275]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_placement_fills_sequences_without_gaps(histogram):
    placed = packing.place(histogram, 64)
    used = defaultdict(list)
    for length, n in histogram.items():
        sequence, offset = placed.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used[s].append((o, length))
    assert sorted(used) == list(range(len(used)))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(length * n for length, n in histogram.items())
    assert len(used) <= 2 * (total // 64) + 1


def test_shortest_packs_first():
    placed = packing.place({7: 1, 5: 1, 2: 2}, 10)
    # 7 and 5 open a pack each; the first 2 goes to the shorter one, then both hold 7 and the next goes to the first.
    assert placed.find(np.array([7, 5, 2, 2]), np.array([0, 0, 0, 1]))[0].tolist() == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        packing.place({11: 1}, 10)


def test_pack_round_trip(docs_of, slow_encoder):
    rng = random.Random(8)
    texts = ["", None, "a", "word " * 9000, "word " * 9000, *("tok " * rng.randrange(1, 900) for _ in range(40))]
    rows = [*enumerate(texts), (0, ""), (None, "no id")]
    got = packing.pack(docs_of(rows), keep_ids=True).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in rows[:-2]:
        expected = [*slow_encoder(text or ""), 1]
        parts = sorted(by_doc[i])
        if i:
            assert [x for _, ids, _ in parts for x in ids] == expected
        assert {n for _, _, n in parts} == {len(expected)}
    assert Counter(len(by_doc[i]) for i in (0, None)) == {2: 1, 1: 1}
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    filled = sum(n for parts in sequences.values() for _, n in parts)
    assert filled / (len(sequences) * packing.CAPACITY) > 0.9


def test_pack_of_nothing(docs_of):
    assert packing.pack(docs_of(["a"]).limit(0)).count() == 0


def test_ranks_count_each_value_apart(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)] + [(0, 4), (0, 4)], "k int, v int")
    got = defaultdict(list)
    for r in tokens.ranked(rows, "k", ["v"]).collect():
        got[r.k].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_context_table_equals_brute_force(docs_of, slow_encoder, monkeypatch):
    monkeypatch.setattr(tokens, "_BLOCK", 8)
    rng = random.Random(9)
    texts = [None, "", *("tok " * rng.randrange(60) for _ in range(50))]
    lengths = [len(slow_encoder(t or "")) for t in texts]
    contexts = tokens.context_table(tokens.length_histogram(docs_of(texts)))
    rows = {r.context_limit: r for r in contexts.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        assert r.n_docs == lengths.count(limit) and r.n_longer == sum(x > limit for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
        assert r.tokens_fitting == sum(x for x in lengths if x <= limit)
        assert r.tokens_kept == sum(min(x, limit) for x in lengths) and r.tokens_cut == sum(max(x - limit, 0) for x in lengths)
    asked = [0, 1, 5, 17, 59, 1000]
    got = {r.context_limit: (r.tokens_kept, r.n_longer) for r in tokens.at_limits(contexts, asked).collect()}
    assert got == {a: (sum(min(x, a) for x in lengths), sum(x > a for x in lengths)) for a in asked}
    assert tokens.context_table(tokens.length_histogram(docs_of(["a"]).limit(0))).count() == 0
