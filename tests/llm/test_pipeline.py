"""The pipeline's stages on a small corpus with planted cases, each judged on its own input."""

import random

import pytest

import corpus_pipeline
from tessera.llm.common import drop_stored, shared_dir
from tessera.llm.packing import Words

P = pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "1eb9c654e721b4f812088970e66a6345cee33dd6"


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choices(["th", "er", "on", "an", "re", "ed", "ti", "es", "ou", "in"], k=r.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    item = prose(5000, 40)
    rows = [(i, prose(i), 1) for i in range(150)]
    rows += [(200 + i, " ".join(w + "***" for w in prose(200 + i, 80).split()), 0) for i in range(40)]
    rows += [(300, prose(3), None), (301, prose(3), None), (302, f"{prose(302)} {item} {prose(303)}", None), (303, f'{prose(304)} token = "{SECRET}" {prose(305)}', None)]
    rows += [(304, " ".join(w + "***" for w in prose(306).split()), None), (305, None, None), (None, prose(307), None)]
    spark.createDataFrame([(i, t, "en", "src0", len(t) if t else None) for i, t, _ in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    start = ids(docs)

    kept = stages["quality_classifier"](spark, docs, sf).cache()
    assert kept.columns == COLUMNS
    gone = start - ids(kept)
    assert 304 in gone and set(range(200, 240)) <= gone and not gone & set(range(150)) and 302 not in gone

    one = stages["simhash_near_dedup"](spark, docs, sf)
    assert one.columns == COLUMNS and start - ids(one) == {300, 301}

    clean = stages["benchmark_decontamination"](spark, docs, sf)
    assert clean.columns == COLUMNS and start - ids(clean) == {302} and clean.count() == docs.count() - 1

    safe = stages["secret_scans"](spark, docs, sf)
    assert safe.columns == COLUMNS and safe.count() == docs.count()
    changed = safe.where("doc_id = 303").first()
    assert SECRET not in changed.text and "[SECRET]" in changed.text and changed.n_chars == len(changed.text)
    assert safe.where("doc_id <> 303").exceptAll(docs).count() == 0


def test_run(spark, sf):
    shared_dir(spark)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {300, 301, 302, 304} & {r.doc_id for r in got} == set() and None in {r.doc_id for r in got}
    whole = Words(P.path("word_bpe_49k.json")).whole
    texts = {i: prose(i) for i in range(150)}
    assert all(r.length == len(whole(texts[r.doc_id])) // 4 + 1 for r in got if r.doc_id in texts and r.piece == 0 and r.start == 0)
    drop_stored(spark)


def test_extra_columns(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(1) for c in ("found", "fp", "score", "d", "piece", "_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_empty(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
