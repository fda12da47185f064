"""Fingerprints, passages and classifiers."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettersift.llm import fingerprints, quality, repeats, samples, toxicity

VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def true_likeness(a, b):
    a, b = (dict(zip(*(x.tolist() for x in fingerprints.weighted_terms(t)), strict=True)) for t in (a, b))
    keys = set(a) | set(b)
    most = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / most if most else 1.0


def test_fingerprints_and_edits(docs_of):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(40)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "éé🙂"), (203, "a"), (4, texts[0]), (500, prose(rng, 40_000))]
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    errors = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edit = fingerprints.edited_text(text, after)
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        errors += [r.near_edited - true_likeness(text, edit), r.near_next - true_likeness(text, after)]
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.3
    assert got[0].fingerprint == got[4].fingerprint and got[200].fingerprint == ""
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs_of(rows)).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}


def test_fingerprints_of_one_row_repeated_rows_and_none(docs_of):
    one = fingerprints.compare_with_edits(docs_of([(7, "a b c d")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    again = fingerprints.compare_with_edits(docs_of([(7, "a b"), (7, "a b"), (None, "c"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in again) == [(0, 0), (0, 1), (7, 3), (7, 3)]
    assert fingerprints.compare_with_edits(docs_of(["a"]).limit(0)).count() == 0


def test_blocks_do_not_change_fingerprints(monkeypatch):
    rng = random.Random(2)
    bags = [fingerprints.weighted_terms(prose(rng, n)) for n in (0, 1, 5, 300, 900)]
    whole = fingerprints.signatures(bags)
    monkeypatch.setattr(fingerprints, "BLOCK", 64)
    assert np.array_equal(whole, fingerprints.signatures(bags))


def test_collisions_equal_weighted_likeness():
    rng = np.random.default_rng(3)
    terms = np.sort(rng.integers(0, 2**62, 60).astype(np.uint64))
    a, b = rng.integers(1, 6, 60), rng.integers(1, 6, 60)
    marks = fingerprints.signatures([(terms, a), (terms, b)], 4000)
    assert (marks[0] == marks[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def brute_longest_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_repeats_are_found_and_clean_documents_left(docs_of):
    rng = random.Random(4)
    words = lambda n: [f"z{rng.randrange(10**7)}" for _ in range(n)]
    passage, long = words(60), words(400)
    fuzzy = [w if i % 12 else f"q{i}" for i, w in enumerate(long)]
    texts = {
        1: words(30) + passage + words(40), 2: words(200), 3: words(10) + passage, 4: passage + words(300), 5: long + words(50),
        6: words(20) + fuzzy + words(20), 7: words(5), 8: passage[:30] + words(100), 9: words(100),
    }
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(10, " ".join(texts[2])), (11, None), (12, ""), (None, " ".join(passage)), (9, " ".join(texts[9]))]
    got = {r.doc_id: r for r in repeats.repeated_passages(docs_of(rows)).collect()}
    assert sorted(got) == [3, 4, 6, 10]
    assert (got[3].start, got[3].end, got[3].source_id, got[3].source_start, got[3].identity) == (10, 70, 1, 30, 1.0)
    assert (got[4].start, got[4].end) == (0, 60)
    assert (got[10].start, got[10].end, got[10].source_id) == (0, 200, 2)
    assert got[6].source_id == 5 and got[6].end - got[6].start >= 380 and got[6].identity > 0.85
    assert repeats.repeated_passages(docs_of(["a"]).limit(0)).count() == 0


def test_every_exact_run_is_covered(docs_of):
    rng = random.Random(5)
    base = [[f"z{rng.randrange(10**6)}" for _ in range(150)] for _ in range(4)]
    texts = []
    for _ in range(40):
        source = rng.choice(base)
        a = rng.randrange(90)
        texts.append([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] + source[a:a + rng.randrange(20, 150)])
    got = {}
    for r in repeats.repeated_passages(docs_of([" ".join(t) for t in texts])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen = set()
    for i, text in enumerate(texts):
        runs = [tuple(text[j:j + 50]) for j in range(len(text) - 49)]
        for j, run in enumerate(runs):
            if run in seen:
                # A part at an end that only a later one of the earlier documents shares may be left off.
                assert len(set(range(j, j + 50)) & got.get(i, set())) >= 40
        seen.update(runs)


def test_chains_are_best_and_alignments_count_pairs():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 9)
        x = np.array(sorted(rng.sample(range(60), n)))
        y = np.array([rng.randrange(60) for _ in range(n)])
        best = [float(repeats.K)] * n
        for i in range(n):
            for j in range(i):
                if y[j] < y[i]:
                    cost = repeats.GAP_COST * (x[i] + y[i] - x[j] - y[j])
                    best[i] = max(best[i], best[j] + repeats.K - cost)
        chain = repeats.chains(x, y)
        assert sorted(i for c in chain for i in c) == list(range(n))
        first = chain[0]
        score = repeats.K * len(first) - repeats.GAP_COST * (x[first[-1]] + y[first[-1]] - x[first[0]] - y[first[0]])
        assert score == pytest.approx(max(best)) or len(chain) == 1
        a, b = [rng.randrange(4) for _ in range(12)], [rng.randrange(4) for _ in range(9)]
        table = [[0] * 10 for _ in range(13)]
        for i in range(12):
            for j in range(9):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert repeats.aligned(a, b) == table[12][9]


def test_alignments_name_the_pairs_they_count():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(25))] for _ in range(2))
        found = repeats.paired(a, b)
        assert len(found) == repeats.aligned(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(p < r and q < s for (p, q), (r, s) in zip(found, found[1:], strict=False))


def test_passages_of_one_pair_are_judged_by_themselves(docs_of):
    rng = random.Random(8)
    words = lambda n: [f"z{rng.randrange(10**7)}" for _ in range(n)]
    one, two, copied, stray = words(60), words(60), words(500), words(5)
    texts = {
        1: words(20) + one + words(100) + two + words(30), 2: words(10) + one + words(100) + two + words(5),
        3: copied, 4: copied[:250] + words(300) + copied[250:],
        5: words(10) + stray + words(35) + one[::-1], 6: words(12) + stray + words(35) + one[::-1] + words(9),
    }
    got = {}
    for r in repeats.repeated_passages(docs_of([(i, " ".join(w)) for i, w in texts.items()])).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.source_id, r.source_start, r.identity))
    assert {i: sorted(rows) for i, rows in got.items()} == {
        2: [(10, 70, 1, 20, 1.0), (170, 230, 1, 180, 1.0)],
        4: [(0, 250, 3, 0, 1.0), (550, 800, 3, 250, 1.0)],
        6: [(52, 112, 5, 50, 1.0)],
    }


def test_a_passage_counts_at_each_of_its_places(docs_of):
    rng = random.Random(9)
    words = lambda n: [f"z{rng.randrange(10**7)}" for _ in range(n)]
    passage = words(60)
    twice = lambda: words(10) + passage + words(30) + passage + words(5)
    texts = [words(20) + passage, twice(), words(40), twice()]
    docs = docs_of([" ".join(t) for t in texts])
    for parts in (1, 4):
        got = repeats.repeated_passages(docs.repartition(parts, "doc_id")).collect()
        assert sorted((r.doc_id, r.start, r.end, r.source_id) for r in got) == [
            (1, 10, 70, 0), (1, 100, 160, 0), (3, 10, 70, 0), (3, 100, 160, 0)]


def test_a_phrase_of_an_earlier_document_loses_no_passage(docs_of):
    rng = random.Random(10)
    words = lambda n: [f"z{rng.randrange(10**7)}" for _ in range(n)]
    line, own = words(18), words(34)
    both = own + line
    texts = {1: words(40) + line + words(30), 5: words(25) + both + words(20), 6: words(15) + both + words(33)}
    cut = words(52)
    texts |= {11 + i: words(9) + cut[13 * i:13 * i + 13] + words(9) for i in range(4)}
    texts |= {20: words(7) + cut + words(7), 21: cut}
    got = repeats.repeated_passages(docs_of([(i, " ".join(w)) for i, w in texts.items()])).collect()
    assert sorted((r.doc_id, r.start, r.end, r.source_id) for r in got) == [(6, 15, 67, 5), (21, 0, 52, 20)]


def test_every_word_of_every_exact_run_is_covered(docs_of):
    rng = random.Random(11)
    base = [[f"z{rng.randrange(10**6)}" for _ in range(150)] for _ in range(4)]
    texts = []
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 4)):
            source, a = rng.choice(base), rng.randrange(130)
            text += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))] + source[a:a + rng.randrange(5, 150)]
        texts.append(text)
    got, seen = {}, set()
    for r in repeats.repeated_passages(docs_of([" ".join(t) for t in texts])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    for i, text in enumerate(texts):
        found = [tuple(text[j:j + 50]) for j in range(len(text) - 49)]
        for j, run in enumerate(found):
            assert run not in seen or set(range(j, j + 50)) <= got.get(i, set())
        seen.update(found)


def changed(rng, words, every):
    """Words with every so manieth one replaced."""
    first = rng.randrange(every)
    return [f"q{rng.randrange(10**7)}" if i % every == first else w for i, w in enumerate(words)]


def test_a_changed_passage_is_found_where_others_have_its_seeds_first(docs_of):
    rng = random.Random(12)
    words = lambda n: [f"z{rng.randrange(10**7)}" for _ in range(n)]
    one, two, long = words(70), words(60), words(120)
    texts = {i: words(9) + one[i * 14:i * 14 + 14] + words(9) for i in range(5)}
    texts |= {10: words(30) + one + words(12), 11: words(8) + changed(rng, one, 15) + words(25)}
    # All but the end stands first in one document, the end in others; the whole in a third.
    texts |= {20: words(20) + long[:62], 21: words(9) + long[60:90] + words(9), 22: words(9) + long[88:] + words(9)}
    texts |= {23: changed(rng, long, 20) + words(30), 24: words(11) + changed(rng, long, 20) + words(5)}
    # The first document with the seeds has them at an earlier place, in another order, too.
    texts |= {30: two[40:] + words(30) + two[20:40] + words(30) + two[:20] + words(40) + two, 31: words(6) + changed(rng, two, 16) + words(6)}
    got = {}
    for r in repeats.repeated_passages(docs_of([(i, " ".join(w)) for i, w in texts.items()])).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.source_id))
    assert sorted(got) == [11, 23, 24, 31]
    for doc, source, start, end in ((11, 10, 8, 78), (24, 23, 11, 131), (31, 30, 6, 66)):
        (row,) = got[doc]  # Fewer words than a window may be left off before a change at an end.
        assert row[2] == source and start <= row[0] < start + repeats.WINDOW and end - repeats.WINDOW < row[1] <= end


def test_changed_passages_of_all_earlier_documents_are_covered(docs_of):
    rng = random.Random(13)
    base = [[f"z{rng.randrange(10**6)}" for _ in range(200)] for _ in range(3)]
    texts = []
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 4)):
            source, a = rng.choice(base), rng.randrange(180)
            text += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
            text += changed(rng, source[a:a + rng.randrange(5, 150)], rng.choice((10, 15, 25)))
        texts.append(text)
    got = {}
    for r in repeats.repeated_passages(docs_of([" ".join(t) for t in texts])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    hashes = [repeats.word_hashes(" ".join(t)) for t in texts]
    known = [repeats.seeds(h) for h in hashes]
    missed = total = 0
    for i, a in enumerate(hashes):
        for j, b in enumerate(hashes[:i]):
            places = [(x, -y) for s, x in zip(*known[i], strict=True) for t, y in zip(*known[j], strict=True) if s == t]
            places = np.abs(np.array(sorted(places)))
            for chain in repeats.chains(*places.T) if len(places) > 1 else []:
                for part in repeats.split(repeats.runs(*places[chain].T), repeats.LIKE) if len(chain) > 1 else []:
                    for start, end, *_ in repeats.alike_parts(repeats.pairs(a, b, part), repeats.LIKE, repeats.MIN_WORDS, repeats.MIN_WORDS):
                        total += end - start
                        # The words between a passage's end and its seed next to it may be left off.
                        inner = set(range(start + repeats.WINDOW - 1, end - repeats.WINDOW + 1))
                        missed += len(inner - got.get(i, set()))
    assert total > 10_000 and missed == 0


def test_a_line_that_all_share_makes_no_pairs():
    rng = random.Random(14)
    line = [f"l{i}" for i in range(25)]
    keys = []
    for _ in range(20):
        words = " ".join([f"z{rng.randrange(10**7)}" for _ in range(60)] + line + [f"z{rng.randrange(10**7)}" for _ in range(60)])
        hashes = repeats.word_hashes(words)
        seed, at = repeats.seeds(hashes)
        shared = (at >= 60) & (at <= 80)
        at, seed = at[shared], seed[shared]
        owner, around = np.zeros(len(at), np.int64), np.full(len(at), 65537)
        keys += repeats.far_pairs(owner, at, seed, around, np.ones(len(at), bool), 50, 0.8, 5, 10)[1].tolist()
    assert not keys


def test_runs_of_one_word_are_matched_from_their_ends():
    one, two = np.full(30, 7, np.uint64), np.full(25, 7, np.uint64)
    one[28:], two[24] = 8, 8
    at, other_at = np.array([*range(25), 40, 60, 61, 90, 120]), np.array([*range(100, 120), 140, 150, 151, 152, 170])
    got = set(zip(*(c.tolist() for c in repeats.met(at, one, other_at, two, 3)), strict=True))
    # Runs of 25, 1 and 2 places against runs of 20, 1 and 3, each from the start and from the end.
    starts, ends = (0, 40, 60), (24, 40, 61)
    lengths, other_lengths = (25, 1, 2), (20, 1, 3)
    other_starts, other_ends = (100, 140, 150), (119, 140, 152)
    want = {(a + i, b + i) for a, n in zip(starts, lengths, strict=True) for b, m in zip(other_starts, other_lengths, strict=True)
            for i in range(min(n, m, 4))}
    want |= {(a - i, b - i) for a, n in zip(ends, lengths, strict=True) for b, m in zip(other_ends, other_lengths, strict=True)
             for i in range(min(n, m, 4))}
    assert want | {(90, 170), (120, 170)} <= got and len(got) <= 2 * len(want)
    x, y = repeats.met(at, one, other_at, two, 3)
    assert all(p < r or (p == r and q > s) for p, q, r, s in zip(x, y, x[1:], y[1:], strict=False))
    assert not len(repeats.met(at[:0], one[:0], other_at, two, 3)[0])


def scores(rows, labels, name):
    test = [(r.score, r.predicted, labels[r.doc_id][name]) for r in rows if r.held_out and r.doc_id in labels]
    caught = np.mean([p for _, p, y in test if y == 1])
    wrong = np.mean([p for _, p, y in test if y == 0])
    return caught, wrong


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_accuracy(spark, name):
    # Insults are rare: with the 300 training rows of the smaller tables few of them are learned.
    sf_dir = "/root/testdata/sf0.1" if name == "toxic" else "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r for r in labels.collect()}
    score, rest = (toxicity.score_toxicity, (4, 2)) if name == "toxic" else (quality.score_quality, (3, 1))
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % rest[0] == rest[1]) and 0 <= r.score <= 1 for r in rows)
    caught, wrong = scores(rows, known, name)
    assert caught >= 0.85 and wrong <= 0.03


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_labels_change_nothing(spark, sf, name):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    score, rest = (toxicity.score_toxicity, (4, 2)) if name == "toxic" else (quality.score_quality, (3, 1))
    rows = score(docs, labels).collect()
    # Nor does what else a row has.
    hidden = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % rest[0]) == rest[1]
    flipped = labels.withColumn(name, F.when(hidden, 1 - F.col(name)).otherwise(F.col(name)))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("y", F.lit(3)).withColumn("p", F.lit(2.0))
    again = {r.doc_id: r.score for r in score(other, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_of_odd_rows(spark, docs_of, score):
    docs = docs_of([(1, None), (2, ""), (None, "you idiot"), (4, "x " * 100_000), (4, "x " * 100_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        rows = score(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert score(docs.limit(0), none).count() == 0


def test_label_model_recovers_rates(spark):
    rng = np.random.default_rng(7)
    toxic = rng.random(20_000) < 0.15
    fire = np.array([[0.02, 0.01, 0.05, 0.05], [0.5, 0.4, 0.6, 0.6]])
    votes = rng.random((20_000, 4)) < fire[toxic.astype(int)]
    votes[:, 3] = votes[:, 2]  # two voters that always agree
    masks = (votes * (1 << np.arange(4))).sum(axis=1)
    values, counts = np.unique(masks, return_counts=True)
    patterns = spark.createDataFrame([(int(v), int(c)) for v, c in zip(values, counts, strict=True)], "mask long, n long")
    model = toxicity.fit_label_model(patterns, 0.1, np.stack([np.full(4, 0.03), np.full(4, 0.5)]))
    assert model.shared[2, 3] > 0.3 and model.shared[0, 1] < 0.2
    alone = toxicity.LabelModel(model.prior, model.fire)
    pair = np.array([0b1100])
    assert model.posterior(pair)[0] < alone.posterior(pair)[0]
    assert np.mean((model.posterior(masks) > 0.5) == toxic) > 0.9


def test_dual_descent_separates():
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 50, 8)) + (50 if y else 0) for y in range(2) for _ in range(40)]
    rows = [np.append(r, 120) for r in rows]
    labels = np.repeat([0, 1], 40)
    w = quality.fit(rows, labels, 128)
    margin = np.array([w[r].sum() + w[-1] for r in rows])
    assert ((margin > 0) == (labels == 1)).all()


def test_shapes():
    assert [quality.shape(w) for w in ("word", "Word,", "WORD!!", "a%%%", "x|", "3.14", "Été")] == ["a", "Aa,", "A!+", "a%+", "a|", "0.0", "Aa"]


def test_fitted_rows_are_bounded_by_row(spark, docs_of):
    rows = [(None, f"no id {i}") for i in range(200)] + [(7, f"one id {i}") for i in range(200)] + [(8, "the same")] * 200
    rows += [(i, f"text {i}") for i in range(100, 300)]
    docs = docs_of(rows).select("doc_id", "text")
    got = toxicity.fit_sample(docs, 50).collect()
    assert len(got) == len(set(got)) == 50 and all(r.doc_id is not None for r in got)
    assert toxicity.fit_sample(docs.where("doc_id is null"), 50).count() == 50 and toxicity.fit_sample(docs.limit(0), 50).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in (7, 8, *range(100, 300))], "doc_id long, toxic int")
    sample, _ = samples.labelled_sample(docs, labels, "toxic", 4, 2, 1000)
    ids = [r.doc_id for r in sample.collect()]
    assert len(ids) == len(set(ids)) > 100
