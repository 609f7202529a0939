import random

import corpus_pipeline as pipeline
from chronoplane.llm import language_id
from chronoplane.llm.pii import KINDS

from tests.llm.test_duplicates import brute_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(8)
    out = []
    for i in range(60):
        words = {"en": "the of and with that from have this", "de": "der die das und mit nicht einen sich"}["en" if i % 2 else "de"].split()
        out.append((i, " ".join(rnd.choice(words) for _ in range(80)), "en" if i % 2 else "de", "s", 0))
    out += [(100, out[3][1], None, "s", 0), (101, out[3][1] + " more", "en", None, 0), (102, None, "en", "s", None), (103, "12345 !!", "en", "s", 0), (104, "жшщ ъыэ " * 30, None, "s", 0), (105, out[5][1] + " a@b.org", None, "s", 0), (106, "the of and 10.0.0.1 with", "en", "s", 0)]
    return out


def test_stages_one_by_one(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    first = pipeline.identify(spark, docs, "")
    assert first.schema == docs.schema
    kept = {r.doc_id: r for r in first.collect()}
    assert set(kept) == {r[0] for r in rows()} - {102, 103, 104} and kept[100].lang == "en"

    second = pipeline.deduplicate(spark, first.union(first.limit(5)), "")
    assert second.columns == docs.columns
    brute = {r[0] for r in brute_near([(r.doc_id, r.text) for r in first.collect()], 5, 80) if r[3]}
    ids = [r.doc_id for r in second.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == brute and not {100, 101, 105} & set(ids)

    third = {r.doc_id: r for r in pipeline.mask(spark, docs.filter("doc_id in (2, 102, 105, 106)"), "").collect()}
    assert third[105].text.endswith("[EMAIL]") and third[106].text == "the of and [IP] with" and third[106].n_chars == len("the of and [IP] with")
    assert third[102].text is None and third[2].text == rows()[2][1]


def test_pipeline_runs_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = pipeline.run(spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    sample = language_id.training_sample(docs.filter(~language_id.held_out()).select("doc_id", "text", "lang"))
    stay = []
    for doc_id, text in texts.items():
        lang, _, rate = language_id.judge([text], sample)[0]
        if lang != "und" and rate < language_id.REJECT_RATE:
            stay.append((doc_id, text))
    assert {r.doc_id for r in packed} == {r[0] for r in brute_near(stay, 5, 80) if r[3]}
    assert len(stay) >= 0.98 * len(texts) and len(KINDS) == 6


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_clashing_columns_and_missing_ids(spark):
    odd = [(*r, 7.5, "keep", 1) for r in rows()[:20]] + [(None, rows()[0][1], "de", "s", 0, 1.5, "me", 2), (None, rows()[0][1], "de", "s", 0, 2.5, None, 3)]
    docs = spark.createDataFrame(odd, SCHEMA + ", score double, pii_spans string, bucket int")
    for stage, n in ((pipeline.identify, 22), (pipeline.deduplicate, 22), (pipeline.mask, 22)):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == n
        assert {(r.doc_id, r.score, r.pii_spans, r.bucket) for r in out.collect()} == {(r[0], *r[5:]) for r in odd}
    packed = pipeline.pack(spark, docs, "").collect()
    assert sum(r.doc_id is None for r in packed) == 2 and len(packed) == 22
