"""The pipeline's stages against what each operator says, and against brute force."""


import corpus_pipeline
from lettersift.llm.queries import ORACLES, QUERIES


def test_stages_on_the_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.saved(stage(spark, kept, sf), name)
        if name != "packing":
            assert result.columns == docs.columns and result.schema.simpleString() == docs.schema.simpleString()
            assert result.select("doc_id").subtract(kept.select("doc_id")).count() == 0
        counts.append((name, result.count()))
        kept, before = result, kept
    numbers = dict(counts)
    assert docs.count() >= numbers["toxicity"] >= numbers["near_duplicates"] >= numbers["decontamination"] == numbers["secret_scans"]
    assert kept.select("doc_id").distinct().count() == before.count()


def test_stages_keep_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (4, "you pathetic worthless idiot", "en", "s", 28)]
    docs = spark.createDataFrame(rows, schema)
    for part in (docs, docs.limit(0)):
        kept = part
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, sf)
        left = {r.doc_id for r in kept.select("doc_id").collect()}
        assert left <= {1, 2, 4, None} and (part is not docs or {1, 2, None} <= left)


def test_rows_are_judged_by_their_own_text(spark, sf, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey"]
    rude = "you pathetic worthless idiot, you stupid moron"
    monkeypatch.setattr(corpus_pipeline, "score_toxicity", lambda docs, labels, carry=(): docs.select(
        "doc_id", docs.text.contains("idiot").cast("int").alias("predicted"), *carry))
    rows = [(7, t, "en", "s", 1) for t in [*clean, "", rude]] + [(None, t, "en", "s", 1) for t in [clean[0], rude, clean[0]]]
    rows += [(8, clean[1], "en", "s", 1), (7, clean[2], "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.toxicity(spark, docs, sf)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((r[0] or 0, r[1]) for r in rows if r[1] != rude)
    kept = corpus_pipeline.near_duplicates(spark, docs.where(docs.text != rude), sf)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(7, ""), (0, clean[0]), *((7, t) for t in clean)])


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secret_scans", "packing"]
