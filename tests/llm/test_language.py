from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from fringeflow.llm import language
from fringeflow.llm.queries import op4_language


def test_held_out_accuracy(spark, data_dir):
    got = op4_language(spark, data_dir)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    asked = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in asked]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_bundles_match_direct_sums():
    """Sums over distinct trigrams equal the sum of each trigram's bound vector in turn."""
    texts = ["Hallo, Welt! ", "a", None, "", "42 !", "ñandú ñandú 日本"]
    letters = language.letter_vectors().astype(int)
    sums = language.bundle(texts, language.TrigramVectors())
    for text, got in zip(texts, sums):
        codes = language.letter_codes(text or "")
        want = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        assert (got == want).all()


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(awkward)
    profiles = language.language_profiles(docs)
    got = language.predict_languages(docs, profiles).collect()
    assert len(got) == len(awkward)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("aa" if letters else "und") and r.n == 7
        assert (r.score > 0) <= letters
    assert language.predict_languages(docs.limit(0), profiles).collect() == []
    assert {r.lang_pred for r in language.predict_languages(docs, {}).collect()} == {"und"}
    named = docs.selectExpr("*", "cast(null as int) as lang_pred")
    kept = language.keep_identified(named)
    assert kept.schema == named.schema and {(r.score, r.lang_pred, r.kept) for r in kept.collect()} == {("x", None, 7)}
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in awkward)


def test_labels_of_held_out_rows_change_nothing(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    other = docs.withColumn("lang", F.when(language.is_held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    key = lambda frame: sorted(map(tuple, language.identify(frame).collect()))
    assert key(docs) == key(other)
