from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from fringeflow.llm import jaccard_join, repeats
from fringeflow.sources.stage_store import settle


def test_stages_clean_and_pack(spark, data_dir):
    """Each stage is held against plain Python over what the one before kept."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, data_dir), name)
        kept[name] = docs
        if name != names[-1]:
            assert docs.columns == kept["documents"].columns
    ids = {name: {r.doc_id for r in frame.select("doc_id").collect()} for name, frame in kept.items()}
    assert ids["language_id"] == ids["documents"]

    # Of each group of near copies the least id stays.
    before = kept["language_id"].collect()
    sets = {r.doc_id: shingles(r.text) for r in before}
    least = {}
    order = sorted(sets)
    for i in order:
        near = [least[j] for j in least if linked(sets[i], sets[j])]
        root = min([i, *near])
        least = {j: root if r in near else r for j, r in least.items()} | {i: root}
    assert ids["near_copies"] == set(least.values())

    # No string of 200 bytes that started twice is left, and untouched texts are as they were.
    texts = {r.doc_id: r.text for r in kept["near_copies"].collect()}
    starts = Counter(b[i : i + 200] for b in (t.encode() for t in texts.values()) for i in range(len(b) - 199))
    twice = {s for s, n in starts.items() if n > 1}
    for r in kept["repeats"].collect():
        left = r.text.encode()
        assert not any(s in left for s in twice) and r.n_chars == len(r.text)
        if not any(s in texts[r.doc_id].encode() for s in twice):
            assert r.text == texts[r.doc_id]

    bench = [r.text for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    for r in kept["repeats"].collect():
        if any(b in r.text for b in bench):
            assert r.doc_id not in ids["decontamination"]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept["decontamination"].collect()}
    packed = Counter()
    for r in kept["packing"].collect():
        packed[r.doc_id] += r.length
    assert packed == wanted


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    common = len(a & b)
    return common and 100 * common >= 80 * (len(a) + len(b) - common)


def test_run_applies_all_stages(spark, data_dir):
    assert corpus_pipeline.run(spark, data_dir).columns[-2:] == ["sequence_id", "offset"]


def test_stages_pass_on_extra_columns_and_empty_tables(spark, make_docs, awkward):
    docs = make_docs(awkward)
    for cleaned in (jaccard_join.keep_one_of_each(docs, 5, 80), repeats.drop_repeats(docs, 200)):
        assert cleaned.columns == docs.columns
    assert repeats.drop_repeats(make_docs([]), 200).collect() == []
