import itertools
import random

import numpy as np
import pytest

from lettersift.llm import near
from lettersift.llm.graph import components

pytestmark = pytest.mark.usefixtures("small_shuffles")


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    take = min(width, len(words))
    return {tuple(words[i:i + take]) for i in range(len(words) - take + 1)}


def brute(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return sorted((i, len(sets[i]), label[i]) for i in sets)


def found(docs, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(docs, **options).collect() if r.doc_id is not None)


def varied(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        place = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[place] = f"x{rng.randrange(10**6)}"
        elif kind < 0.7 and len(words) > 1:
            del words[place]
        else:
            words.insert(place, f"y{rng.randrange(10**6)}")
    return words


def collection(seed, groups=12, size=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 4, 6, 9, 20, 60, 200]))]
        for _ in range(size):
            rows.append(" ".join(varied(rng, base, rng.choice([0, 1, 1, 2, 3]))))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80)])
def test_groups_equal_brute_force(docs_of, width, num):
    rows = collection(width)
    assert found(docs_of(rows), width=width, num=num, den=100) == brute(rows, width, num, 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_large_clusters_are_compared_in_blocks(docs_of, monkeypatch, seed):
    """Blocks of a few documents, so that both rounds of large clusters take part."""
    monkeypatch.setattr(near, "BLOCK_DOCUMENTS", 4)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 400)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = list(enumerate(" ".join(varied(rng, base, rng.choice([1, 2, 3, 4]))) for _ in range(60)))
    assert found(docs_of(rows)) == brute(rows, 5, 80, 100)


def test_hot_tiles(docs_of, monkeypatch):
    """Nearly every shared tile is hot: copies still find each other, and a common passage ties nothing."""
    monkeypatch.setattr(near, "HOT_TILE", 2)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [" ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 90))] + passage) for _ in range(40)]
    rows += [" ".join(varied(rng, passage, 1)) for _ in range(15)] + [r + " end" for r in rows[:10]]
    rows = list(enumerate(rows))
    assert found(docs_of(rows)) == brute(rows, 5, 80, 100)


def test_exact_threshold(docs_of):
    words = [f"w{i}" for i in range(103)]
    rows = [(5, " ".join(words)), (9, " ".join(words[:88])), (7, " ".join(words[:87]))]  # 100, 85 and 84 shingles
    got = dict((i, c) for i, _, c in found(docs_of(rows[:2]), width=4, num=85, den=100))
    assert got == {5: 5, 9: 5}
    got = dict((i, c) for i, _, c in found(docs_of([rows[0], rows[2]]), width=4, num=85, den=100))
    assert got == {5: 5, 7: 7}


def test_odd_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one TWO"), (5, "one two"), (6, "one two three"), (7, long), (8, long),
            (None, "one two"), (9, "É e"), (10, "é e"), (5, "one two")]
    got = near.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by_id == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (29_996, 7), 8: (29_996, 7),
                     None: (1, None), 9: (1, 9), 10: (1, 10)}


def test_empty_table_and_dropping(docs_of):
    assert near.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0
    docs = docs_of([(3, "a b c"), (1, "a b c"), (2, "a b d"), (1, "a b c"), (4, None), (5, None), (None, "a b c")])
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 5] and ids.count(None) == 1


def test_batches_of_tiles_are_bounded():
    """A batch of texts gave all its tiles at once, whatever their number; now a batch ends with the set that fills it."""
    rng = np.random.default_rng(11)
    bands = near.Bands(80, 100)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 4000))) for _ in range(400)]
    texts += texts[:200] + [None, "", "one"]
    batches = list(near.tile_rows(texts, 5, bands))
    largest = max(sum(len(keys) for keys, _, _ in bands.tiles(near.shingle_set(t, 5))) for t in texts[:400])
    assert len(batches) > 1 and max(b.num_rows for b in batches) < near.BATCH_TILES + largest
    got = {(t, d) for b in batches for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    wanted = set()
    for text in texts:
        shingles = near.shingle_set(text, 5)
        for keys, _, _ in bands.tiles(shingles) if len(shingles) else []:
            wanted |= {(int(k), near._digest(shingles)) for k in keys.view(np.int64)}
    assert got == wanted and sum(b.num_rows for b in batches) == len(wanted)


def test_batches_are_small_in_a_session_of_the_caller(spark, docs_of):
    """Sessions not built by build_session sent 10,000 texts to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        near.drop_near_duplicates(docs_of(["a b c", "a b c d"]))
        assert int(spark.conf.get(key)) <= 2000
    finally:
        spark.conf.set(key, before)


def test_tiles_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    bands = near.Bands(80, 100)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        gone = rng.random(len(a)) < rng.choice([0.02, 0.1])
        extra = rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 10) + 1)), dtype=np.int64).astype(np.uint64)
        b = np.unique(np.concatenate([a[~gone], extra]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            of = lambda s: {first: (set(keys.tolist()), spare) for keys, spare, first in bands.tiles(s)}
            ours, theirs = of(a), of(b)
            band = max(first for first in ours if first <= min(len(a), len(b)))
            shared = len(ours[band][0] & theirs[band][0])
            assert shared >= max(1, ours[band][1], theirs[band][1])


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 200, 40).astype(np.uint64) * np.uint64(2**55 + 12345)) for _ in range(60)]
    sets += [np.setdiff1d(s, s[:2]) for s in sets[:30]]
    links = near.link_sets(sets, np.arange(len(sets)), np.ones(len(sets), bool), 80, 100)
    label = list(range(len(sets)))
    for a, b in links:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            assert label[a] == label[b]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(200, i) for i in range(201, 260)]
    rng.shuffle(chain)
    links = spark.createDataFrame([*chain, *star, (300, 300), (None, 4)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 260)}}
    assert components(links.limit(0)).count() == 0
