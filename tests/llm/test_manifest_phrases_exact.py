"""The Merkle manifest, phrase collocations and exact duplicates against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lettersift.llm import common, exact, manifest, phrases

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
CLASHING = ("group", "node", "row", "block", "level0", "proof", "position", "n", "lead", "thirds", "_row", "_id", "_text", "_digest", "keep_id")


def docs_of(spark, rows, columns=CLASHING):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in columns})


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(nodes):
    """Root and, for each node, ``[(left, right)]`` of the levels with more than one node."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            run = nodes[at // 16 * 16:at // 16 * 16 + 16]
            proofs[i].append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
            places[i] = at // 16
        nodes = [sha(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def brute_manifest(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append((row[0] is not None, row[0] or 0, sha(*map(part, row))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([leaf for *_, leaf in sorted(sources[s])]) for s in names}
    root, above = brute_tree([trees[s][0] for s in names])
    found = []
    for s, upper in zip(names, above, strict=True):
        for (known, number, leaf), proof in zip(sorted(sources[s]), trees[s][1], strict=True):
            found.append((number if known else None, leaf, trees[s][0], root, proof + upper))
    return found


@pytest.mark.parametrize("sizes", [[1], [2], [16, 17, 1], [256, 257], [600, 1, 5000, 0, 300], [1] * 300])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = []
    for s, size in enumerate(sizes):
        name = [None, "", "é", "Z", "a"][s] if s < 5 else f"s{s}"
        rows += [(rng.choice([None, *range(9 * size)]), name, rng.choice([None, "", "en"]), rng.choice([None, 3]),
                  rng.choice([None, "", "Text É🙂\n", "x"])) for _ in range(size)]
    rows += rows[:3]
    rng.shuffle(rows)
    got = manifest.manifest(docs_of(spark, rows), ("doc_id",)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_finds_tampering(spark):
    rows = [(i, f"s{i % 3}", "en", 4, f"Text {i}") for i in range(400)] + [(1000, "long", None, None, "w " * 200_000)]
    table = docs_of(spark, rows).withColumn("other", manifest.leaf_hash(*[F.col(c) for c in manifest.FIELDS[:-1]], F.lower("text")))
    proofs = manifest.manifest(table, ("doc_id", "other")).withColumns({
        "own": manifest.folded(F.col("proof"), F.col("leaf")), "changed": manifest.folded(F.col("proof"), F.col("other")),
        "siblings": manifest.proof_text(F.col("proof"))}).collect()
    assert len(proofs) == 401 and all(r.own == r.root for r in proofs)
    assert all((r.changed == r.root) == (r.doc_id == 1000) for r in proofs)
    assert all(len(r.siblings) % 64 == 0 for r in proofs)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(docs_of(spark, [])).count() == 0


def brute_phrases(rows, min_count, top):
    counts = Counter()
    for _, _, lang, _, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for size in (1, 2, 3):
                counts.update((lang if lang is not None else "und", *words[i:i + size]) for i in range(len(words) - size + 1))
    totals = Counter()
    for (lang, *words), n in counts.items():
        totals[lang] += n if len(words) == 1 else 0
    found = defaultdict(list)
    for (lang, *words), a in counts.items():
        if len(words) == 1 or a < min_count:
            continue
        if any(100 * n >= 50 * a and n >= min_count for (other, *more), n in counts.items()
               if other == lang and len(more) == 3 and len(words) == 2 and words in (more[:2], more[1:])):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -score) for lang, own in found.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def random_texts(rng, n):
    vocabulary = ["a", "B", "the", "É", "é", "x🙂", "new", "York", "city", "0", "\x0e", "\xa0"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!?", "\x0b"]
    texts = []
    for _ in range(n):
        words = [rng.choice(["new York city", rng.choice(vocabulary)]) for _ in range(rng.randrange(30))]
        texts.append("".join(w + rng.choice(gaps) for w in words))
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, monkeypatch, small):
    rng = random.Random(7)
    texts = [None, "", " \t.", "..", *random_texts(rng, 120), " ".join(random_texts(rng, 400))]
    rows = [(i, "s", rng.choice(["en", "en", "de", None, "und", "a\tb"]), 1, t) for i, t in enumerate(texts)]
    rows += rows[5:9]
    if small:  # chunks of few words and hot buckets; the functions travel by value, so workers see these settings
        from pyspark import cloudpickle

        monkeypatch.setattr(phrases, "CHUNK_WORDS", 7)
        monkeypatch.setattr(phrases, "CHUNK_BYTES", 50)
        monkeypatch.setattr(phrases, "HOT_BUCKETS", 200)
        cloudpickle.register_pickle_by_value(phrases)
    for min_count, top in ((10, 2000), (3, 5)):
        got = sorted(map(tuple, phrases.collocations(docs_of(spark, rows), min_count, top).collect()))
        assert got == brute_phrases(rows, min_count, top)


def test_phrase_counts_of_a_long_repetition(spark):
    rows = [(1, "s", "en", 1, "hot pair " * 300_000), (2, "s", "en", 1, None)]
    got = {r.phrase: (r.a, r.l, r.r, r.n) for r in phrases.collocations(docs_of(spark, rows)).collect()}
    assert got == {"hot pair hot": (299_999, 300_000, 300_000, 600_000), "pair hot pair": (299_999, 300_000, 300_000, 600_000)}


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_000_000_000)], "a long, l long, r long")
    exact_ = lambda c: F.col(c).cast("decimal(15,0)")
    row = counts.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * (exact_("a") * exact_("a"))).withColumn("area", exact_("l") * exact_("r"))
    assert row.select(F.expr("top div area")).first()[0] == 1_000_000 * 3_000_000_000**2 // (3_000_000_001 * 3_000_000_000)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, "s", "en", 1, " . "), (2, None, None, None, None)])).count() == 0


def exact_rows(rng):
    long = "long text " * 50_000
    texts = [None, "", "a", "a ", "A", "é", "é", long, long + "x", long[:-1] + "y", *(("p" * 300) + str(i % 4) for i in range(20))]
    rows = [(rng.choice([None, *range(400)]), f"s{i}", "en", i, rng.choice(texts)) for i in range(300)]
    return rows + rows[:20] + [(7, "s", "en", 1, "same")] * 5 + [(None, "s", "en", 1, "nameless")] * 2


def test_exact_groups_equal_brute_force(spark, monkeypatch):
    rows = exact_rows(random.Random(9))
    groups = defaultdict(list)
    for r in rows:
        groups[r[4] or ""].append(r[0])
    biggest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for hot in (1000, 3):  # large groups by broadcast, or nearly none
        monkeypatch.setattr(common, "HOT_SHARE", hot)
        got = exact.exact_duplicates(docs_of(spark, rows), ("doc_id", "text")).collect()
        assert Counter((r.doc_id, r.text, r.keep_id, r.group_size) for r in got) == Counter(
            (r[0], r[4], biggest[r[4] or ""], len(groups[r[4] or ""])) for r in rows)
        kept = Counter(r.text or "" for r in got if r.kept)
        assert kept == Counter({t: 1 for t in groups})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_steps_read_only_what_may_repeat(spark):
    rows = [(i, "s", "en", 1, "x" * i) for i in range(50)] + [(100, "s", "en", 1, "a" * 300), (101, "s", "en", 1, "b" * 300)]
    docs = docs_of(spark, rows).select(F.octet_length("text").alias("_length"), F.xxhash64(F.left("text", F.lit(256))).alias("_prefix"))
    lengths = exact._passing(docs, exact._repeated(docs, "_length"), "_length").where("_again")
    assert {r._length for r in lengths.collect()} == {300}
    assert exact._repeated(lengths, "_length", "_prefix").count() == 0


def test_exact_dedup_keeps_columns_and_one_row(spark):
    docs = docs_of(spark, [(1, "a", "en", 1, "t"), (2, "b", "de", 2, "t"), (2, "b", "de", 2, "t"), (None, "c", None, None, None)], CLASHING[:12])
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.source) for r in kept.collect()) == [(0, "c"), (2, "b")]
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
