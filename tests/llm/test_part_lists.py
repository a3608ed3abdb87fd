"""Lists of the n-gram join's screen: linked sets meet, texts that share single shingles by chance don't."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellwright.llm import ngram_join


@pytest.mark.parametrize("top,bottom", [(9, 10), (4, 5), (1, 2)])
def test_linked_sets_have_lists_in_common(top, bottom):
    rng = np.random.default_rng(5)
    sets, linked = [], 0
    for n in [*range(1, 60), *rng.integers(60, 3000, 60).tolist()] * 3:
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        lost = int(rng.integers(0, n * (bottom - top) // bottom + 1))  # up to the most that two linked sets can differ in
        more = int(rng.integers(0, max(0, (n - lost) * bottom // top - n) + 1))
        sets += [np.unique(a), np.unique(np.append(a[lost:], rng.integers(0, 1 << 64, more, dtype=np.uint64)))]
    lists, need = ngram_join.part_lists(sets, top, bottom)
    for k in range(0, len(sets), 2):
        same = len(np.intersect1d(sets[k], sets[k + 1]))
        if same == len(sets[k]) == len(sets[k + 1]) or bottom * same < top * (len(sets[k]) + len(sets[k + 1]) - same):
            continue
        linked += 1
        assert len(np.intersect1d(lists[k], lists[k + 1])) >= max(need[k], need[k + 1]) > 0
    assert linked > 200
    assert [len(x) for x in ngram_join.part_lists([np.zeros(0, np.uint64)], top, bottom)[0]] == [0] and ngram_join.part_lists([], top, bottom)[0] == []


def test_texts_that_share_shingles_by_chance_have_no_differences(spark, monkeypatch):
    """Words are few, so all shingles of a text are elsewhere too: no text but the copies goes beyond the screen, in whatever number they come."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 12, 120)) for _ in range(400)]
    texts += [x + " end" for x in texts[:5]]
    written = {}
    stash = ngram_join.stash

    def seen(df, name):
        written[name] = stash(df, name)
        return written[name]

    monkeypatch.setattr(ngram_join, "stash", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = ngram_join.ngram_jaccard_join(docs, words=3, top=9, bottom=10).filter("component_id <> doc_id")
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(400 + k, k) for k in range(5)]
    assert written["families"].count() < 20 and written["differences"].agg(F.sum(F.size("diff"))).first()[0] < 1000


def test_a_passage_that_many_copies_hold_makes_no_family_of_them(spark, monkeypatch):
    """Pairs of near copies, each pair's texts its own but for a passage that all have: a pair is a family."""
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [passage + " " + " ".join(f"w{k}" for k in rng.integers(0, 1 << 40, 300)) for _ in range(30)]
    written = {}
    stash = ngram_join.stash
    monkeypatch.setattr(ngram_join, "stash", lambda df, name: written.update({name: stash(df, name)}) or written[name])
    docs = spark.createDataFrame([(2 * k + x, text + " end" * x) for k, text in enumerate(texts) for x in range(2)], "doc_id bigint, text string")
    found = ngram_join.ngram_jaccard_join(docs, words=5, top=4, bottom=5).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found) and len(found) == 60
    sizes = written["families"].groupBy("family").count().agg(F.count("*"), F.max("count")).first()
    assert tuple(sizes) == (30, 2)


def test_texts_of_the_pipeline_are_not_shuffled_for_ids_that_are_broadcast(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1 << 40, 60)) for _ in range(20)]
    rows = [(k, x, "en", "a", len(x)) for k, x in enumerate([*texts, *(x + " end" for x in texts[:5])])]
    docs = spark.createDataFrame([*rows, (None, None, "en", "a", 0), (None, texts[0], "en", "a", 0), (50, "", "en", "a", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert " Exchange " not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == [-1, *range(20), 50]
    twice = corpus_pipeline.one_of_each_group(spark, docs.unionByName(docs), "")
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in twice.collect()) == [-1, *range(20), 50]
