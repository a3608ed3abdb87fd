"""Operators on training data: against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.llm import attention, line_dedup, lm_scoring, media, mixing, ngram_join, packing, quality, substring_dedup, token_store, vector_dedup
from cellwright.llm.common import new_path, tokenizer_path
from cellwright.llm.graph import components
from cellwright.llm.queries import ORACLE_SQL, QUERIES
from cellwright.llm.tokens import encoded, encoder
from cellwright.llm.words import shingle_sets

WORDS = "the of and to in stone river light under green winter".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rate double, draw string, key string, kept string"


def corpus():
    rng = np.random.default_rng(0)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    base, passage = say(120), say(60)
    texts = [None, "", " ", "\n\n", "a", "One two", base, base, base.replace("stone", "rock", 1), base + " end", passage + "\n" + say(40), say(30) + "\n" + passage, "x" * 3000, "ab" * 1500, say(4000), "é ü\xa0ß \t z", say(50), say(50) + "\nshared line", say(20) + "\n Shared Line \n"]
    return [(k, t, "en", ["s0", "s1", None][k % 3], None if t is None else len(t), 1.0, "d", "k", "x") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] or "" for r in corpus()}


def ids_of(text):
    return encoder(tokenizer_path()).tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer():
    odd = ["a  b", " a", "a ", "  ", "\n a\n\n  b \n", "don't 's", "x\0y z", "", "é  ü", "a,b. c., d.\n.e", "\nfoo\n", "x.", "a\tb", "a\r\nb", "a　 b", "<|endoftext|> a", *TEXTS.values()]
    for a, b, flat, counts in encoded([t.encode() for t in odd], tokenizer_path(), most=500):
        ends = np.cumsum(counts)
        for k in range(a, b):
            assert flat[ends[k - a] - counts[k - a] : ends[k - a]].tolist() == ids_of(odd[k])


def test_added_tokens_are_encoded_as_the_file_says():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    texts = ["<|endoftext|> a", "x <|endoftext|>", "a<|endoftext|>\n b", "<|endoftext", "plain text"]
    found = [part.tolist() for _, _, flat, counts in encoded([t.encode() for t in texts], tokenizer_path()) for part in np.split(flat, np.cumsum(counts)[:-1])]
    assert found == [fresh.encode(t, add_special_tokens=False).ids for t in texts] and found[0] == [50256, 257]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 7), (7, 6), *((20, k) for k in range(21, 60))]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, **dict.fromkeys(range(20, 60), 20)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines(docs, empty, keep_first):
    got = {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["text"]) for r in line_dedup.line_dedup(docs, min_docs=2, keep_first=keep_first).collect()}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders, first = {}, {}
    for i, t in TEXTS.items():
        for p, line in enumerate(t.split("\n")):
            holders.setdefault(key(line), set()).add(i)
            first.setdefault(key(line), (i, p))
    for i, t in TEXTS.items():
        lines = t.split("\n")
        gone = [bool(key(x)) and len(holders[key(x)]) >= 2 and not (keep_first and first[key(x)] == (i, p)) for p, x in enumerate(lines)]
        assert got[i][:2] == (len(lines), sum(gone)) and (got[i][2] or "") == "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
    assert line_dedup.line_dedup(empty).count() == 0


def test_poisson_mix(spark, docs, empty):
    n, rate = 4000, {"a": 0.25, "b": 4.0}
    many = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 16 == 0, "b").otherwise("a").alias("source"))
    targets = spark.createDataFrame([("a", 15 / 19 * 0.25 * 19 / 15 * 15), ("b", 4.0)], "source string, weight double")
    got = {r["source"]: r["count"] for r in mixing.poisson_mix(many, targets, seed=1).groupBy("source").count().collect()}
    share = got["b"] / (got["a"] + got["b"])
    assert abs(share - 4.0 / (4.0 + 3.75)) < 0.05 and rate
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    counts = [r[0] for r in u.select(mixing.poisson_inverse(F.col("u"), F.lit(3.0))).collect()]
    assert np.mean(counts) == pytest.approx(3, abs=0.02) and np.var(counts) == pytest.approx(3, abs=0.1)
    out = mixing.poisson_mix(docs, seed=2)
    assert set(docs.columns) < set(out.columns) and mixing.poisson_mix(empty).count() == 0
    again = mixing.poisson_mix(docs.repartition(3), seed=2)
    assert sorted(r["mix_key"] for r in out.collect()) == sorted(r["mix_key"] for r in again.collect())


@pytest.mark.parametrize("rate", [40, 1300])
def test_a_rare_source_is_drawn_as_poisson(spark, rate):
    n = 60
    many = spark.range(n * rate * 2 - n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "rare").otherwise("often").alias("source"))
    out = mixing.poisson_mix(many, seed=4, rate_col="rate").filter("source = 'rare'")
    counts = [r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    mean = out.first()["rate"]
    assert len(counts) == n and abs(np.mean(counts) - mean) < 4 * (mean / n) ** 0.5
    assert min(counts) < mean - 1.5 * mean**0.5 and 0.5 * mean < np.var(counts) < 1.7 * mean


def covered(length, keep_first):
    count, seen, out = {}, set(), {}
    for t in TEXTS.values():
        b = t.encode()
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    for i, t in TEXTS.items():
        b = t.encode()
        marks = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if (s in seen) if keep_first else count[s] > 1:
                marks[k : k + length] = True
            seen.add(s)
        out[i] = marks
    return out


@pytest.mark.parametrize("keep_first,hot", [(False, 2000), (True, 2000), (False, 1)])
def test_substrings(docs, empty, monkeypatch, keep_first, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "CROWD", hot)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, length=200, keep_first=keep_first).collect()}
    for i, marks in covered(200, keep_first).items():
        b = np.frombuffer(TEXTS[i].encode(), np.uint8)
        assert bytes(got[i]["kept"]) == b[~marks].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), marks.sum(), (np.diff(marks.astype(int), prepend=0) == 1).sum())
    if hot == 1:
        assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("times", [3, 4, 8, 12])
def test_a_text_of_period_137_repeats_inside(spark, times):
    line = "".join(chr(97 + k) for k in np.random.default_rng(6).integers(0, 26, 136)) + "\n"
    one = spark.createDataFrame([(1, line * times)], "doc_id bigint, text string")
    for keep_first in (False, True):
        (got,) = substring_dedup.substring_dedup(one, length=200, keep_first=keep_first).collect()
        strings = [(line * times)[k : k + 200] for k in range(137 * times - 199)]
        marks = np.zeros(137 * times, bool)
        for k, x in enumerate(strings):
            if x in strings[:k] or (not keep_first and strings.count(x) > 1):
                marks[k : k + 200] = True
        assert marks.any() and got["n_removed"] == marks.sum()


def test_packing_plan_fits_and_is_tight():
    rng = np.random.default_rng(1)
    for hi, n in ((2048, 3000), (300, 500), (5, 50)):
        sizes = rng.integers(1, hi + 1, n)
        counts = np.bincount(sizes, minlength=2049)
        bins = packing.plan(counts, 2048)
        used = np.zeros(2049, np.int64)
        for times, lengths in bins:
            assert sum(lengths) <= 2048
            np.add.at(used, lengths, times)
        assert (used == counts).all()
        assert sum(t for t, _ in bins) <= math.ceil(sizes.sum() / 2048) * 1.02 + 1


def test_packing_places(docs, empty):
    rows = packing.best_fit_packing(docs, tokenizer_path(), capacity=64, end_id=0).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in TEXTS.items():
        ids = [*ids_of(t), 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 64 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for r in sorted(places, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.best_fit_packing(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("words,top,bottom", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(docs, empty, words, top, bottom):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs, words=words, top=top, bottom=bottom).collect()}
    sets = {i: set(s.tolist()) for i, s in zip(TEXTS, shingle_sets([t.encode() for t in TEXTS.values()], words), strict=True)}
    name = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and bottom * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    assert got == {i: (len(sets[i]), name[i]) for i in sets}
    if words == 3:
        assert ngram_join.ngram_jaccard_join(empty).count() == 0


@pytest.mark.parametrize("words,top,bottom", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join_of_groups_of_near_copies(spark, words, top, bottom):
    rng = np.random.default_rng(12)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    texts, one, two = [], say(150), say(90)
    for k in range(70):  # copies with 0 to 6 words changed, of one text or of its extension by another
        base = list(one) if k % 3 else one + two
        for at in rng.choice(len(base), int(rng.integers(0, 7)), replace=False):
            base[at] = f"e{rng.integers(0, 6)}"
        texts.append(" ".join(base))
    texts += [" ".join(one[:40] + say(40)) for _ in range(10)] + [texts[3], None]
    docs = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = [r["component_id"] for r in ngram_join.ngram_jaccard_join(docs, words=words, top=top, bottom=bottom).orderBy("doc_id").collect()]
    sets = [set(s.tolist()) for s in shingle_sets([(t or "").encode() for t in texts], words)]
    name = [100 + k for k in range(len(texts))]
    edges = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and bottom * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b])]
    for _ in name:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    assert got == name and 5 < len(set(got)) < 75


def test_media(spark, docs, empty):
    path = new_path(spark, "media")
    media.write_archives(docs, path)
    whole = {r["doc_id"]: r for r in media.media_features(media.read_archives(spark, path)).collect()}
    small = {r["doc_id"]: r for r in media.media_features(media.read_archives(spark, path, range_bytes=700)).collect()}
    assert whole == small and set(whole) == set(TEXTS)
    for i, t in TEXTS.items():
        b = t.encode()
        payload = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
        r = whole[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest()
    assert whole[6]["feature"] == whole[7]["feature"]
    none = new_path(spark, "media")
    media.write_archives(empty, none)
    assert media.read_archives(spark, none).count() == 0


def test_damaged_members_fail():
    png = bytearray(media.to_png(media.padded(b"text")))
    png[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(png))


def test_token_store(spark, docs, empty):
    path = new_path(spark, "store")
    token_store.write_store(docs, path, tokenizer_path(), end_id=2)
    start = 0
    for r in token_store.verified(spark, path).orderBy("doc_id").collect():
        ids = [*ids_of(TEXTS[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    hashes = [bytes(r["hash"]) for r in token_store.read_chunks(spark, path).collect()]
    assert len(hashes) == len(set(hashes))
    none = new_path(spark, "store")
    token_store.write_store(empty, none, tokenizer_path())
    assert token_store.verified(spark, none).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50000, 9000).astype(np.uint32), rng.integers(0, 50000, 700).astype(np.uint32)
    both = np.concatenate([b, a])
    one, two = set(token_store.cut_points(a, np.array([9000])).tolist()), set((token_store.cut_points(both, np.array([9700])) - 700).tolist())
    assert len(one & two) > 0.8 * len(one)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (8, 16))
    x = np.concatenate([rng.normal(0, 1, (60, 16)), *(c + rng.normal(0, s, (25, 16)) for c, s in zip(centre, (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35), strict=True))])
    rows = [(k, [float(v) for v in r], "m") for k, r in enumerate(x)]
    rows += [(1000, rows[70][1], "m"), (1001, None, "m"), (1002, [0.0] * 16, "m"), (1003, [float("nan")] * 16, "m"), (1004, [1.0, None], "m"), (1005, [], "m"), (1006, [1.0, 2.0], "m")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, kept string")
    got = {r["vec_id"]: r for r in vector_dedup.vector_dedup(df).collect()}
    full = np.concatenate([x, x[70:71]])
    names = [*range(len(x)), 1000]
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    found = sum(got[i]["n_links"] for i in names)
    assert 0.97 * (link.sum() - len(names)) <= found <= link.sum() - len(names)
    for i in range(1001, 1007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[1000]["component_id"] == got[70]["component_id"]
    assert vector_dedup.vector_dedup(df.limit(0)).count() == 0


def test_quality_separates_and_keeps(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.importance_resample(docs, labels, seed=1).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.percentile("log_weight", F.lit(0.5)).alias("w")).collect()
    by = {r["quality"]: r for r in out}
    assert by[1]["kept"] > 0.98 and by[1]["w"] > by[0]["w"]
    ten = quality.importance_resample(docs, labels, seed=1, k=10)
    assert ten.filter("kept").count() == 10
    assert quality.importance_resample(docs.limit(0), labels).count() == 0
    assert quality.importance_resample(docs, labels.limit(0)).filter("kept").count() == docs.count()


def test_kth_largest(spark):
    values = [float(v) for v in np.random.default_rng(4).normal(0, 1, 500).round(1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 500):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 501) is None


def test_training_makes_projections_at_once():
    """Each step multiplies all its places by the joined projections: no product with one window's matrix."""
    rng = np.random.default_rng(4)
    ids = rng.integers(1, attention.KNOWN, 400)
    inputs, targets, _ = attention.windows(ids, np.array([150, 250]))
    p = attention.first_params(np.bincount(ids, minlength=attention.KNOWN), 2)
    x, joint = attention._hidden(p, inputs)[:2]
    assert x.shape == (inputs.size, attention.DIM) and joint.shape == (attention.DIM, 3 * attention.DIM)
    loss = [attention.gradients(q, inputs, targets)[0] for q in (p, attention.train(p, inputs, targets, 1))]
    none = attention.gradients(p, inputs[:1], np.where(np.arange(attention.WINDOW) == 3, targets[:1], -1))
    assert loss[1] < loss[0] and np.isfinite(none[0]) and np.count_nonzero(none[1]["c"] > 0) >= attention.CLASSES - 1


def test_gradients_and_windows():
    rng = np.random.default_rng(5)
    ids, counts = rng.integers(0, 300, 200), np.array([1, 24, 25, 44, 45, 61])
    inputs, targets, owner = attention.windows(ids, counts)
    for k in range(len(counts)):
        own = targets[owner == k]
        assert own[own >= 0].tolist() == ids[counts[:k].sum() : counts[: k + 1].sum()].tolist()
    p = {k: v.astype(np.float64) for k, v in attention.first_params(np.bincount(ids, minlength=attention.KNOWN).astype(float), 1).items()}
    _, g = attention.gradients(p, inputs, targets)
    for name, at in (("E", (int(ids[0]), 1)), ("Q", (2, 3)), ("K", (1, 1)), ("V", (0, 4)), ("W", (3, 5)), ("b", (2,)), ("C", (0, 1)), ("U", (int(ids[3]), 2)), ("u", (int(ids[3]),))):
        loss = []
        for step in (1e-4, -1e-4):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            loss.append(attention.gradients(q, inputs, targets)[0])
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=2e-2, abs=1e-5)
    logs = attention.log_probs(p, inputs, targets)
    assert -logs.sum() / (targets >= 0).sum() == pytest.approx(attention.gradients(p, inputs, targets)[0], rel=1e-4)


def test_language_model(spark, docs, empty):
    import collections

    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs, tokenizer_path()).collect()}
    words = {i: [*t.encode().lower().split(), None] for i, t in TEXTS.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert -1e6 < r["score"] < 0
    assert lm_scoring.lm_scores(empty, tokenizer_path()).count() == 0


def test_language_model_learns_from_all_training_documents(spark, monkeypatch):
    class Seen(Exception):
        pass

    def stop(table, *_):
        raise Seen(table.count(), table.select("replica").distinct().count(), table.groupBy("replica").agg(F.sum(F.size("ids")).alias("n")).agg(F.max("n")).first()[0])

    monkeypatch.setattr(lm_scoring, "fitted", stop)
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.lit(" ".join(WORDS * 110)).alias("text"))  # 1210 words each
    with pytest.raises(Seen) as seen:
        lm_scoring.lm_scores(docs, tokenizer_path())
    rows, replicas, most = seen.value.args
    assert rows == docs.filter(~lm_scoring.held_out("doc_id")).count()
    assert replicas == math.ceil(rows * 1210 / lm_scoring.REPLICA_WORDS) and most < 1.5 * lm_scoring.REPLICA_WORDS


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= 1.5 * n, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() >= docs.count()


def test_null_and_repeated_ids_keep_their_texts(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    twin, other = say(300), say(300)
    rows = [(None, say(30)), (None, say(40)), (None, ""), (None, None), (7, say(30)), (7, twin), (7, other), (8, twin + " end"), (9, other + " end"), (3, say(20)), (3, say(25))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [*rows, rows[4], rows[0]]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert kept == sorted((str(i), str(t)) for i, t in rows if i not in (8, 9))
    found = {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert {(8, 7), (9, 7), (3, 3), (None, None)} < found
    lines = [(None, "common\nown a"), (None, "own b\ncommon"), (1, "common\nown c"), (1, "own d\nown e"), (2, "common\nown f")]
    two = spark.createDataFrame(lines, "doc_id bigint, text string")
    got = sorted(r["text"] for r in line_dedup.line_dedup(two, min_docs=3).collect())
    assert got == ["own a", "own b", "own c", "own d\nown e", "own f"]
    first = sorted(r["text"] for r in line_dedup.line_dedup(two, min_docs=3, keep_first=True).collect())
    assert sum("common" in x for x in first) == 1 and sum(x.count("own") for x in first) == 6


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for name_ in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{sf}/{name_}.parquet'")
    df = QUERIES[name](spark, sf)
    answer = con.sql(ORACLE_SQL[name])
    at = [answer.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in answer.fetchall())


def test_scores_do_not_depend_on_partitions(spark, docs):
    runs = [{r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs.repartition(k), tokenizer_path()).collect()} for k in (1, 7)]
    assert runs[0] == pytest.approx(runs[1], rel=1e-4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id bigint, quality int")
    weights = [{r["doc_id"]: r["log_weight"] for r in quality.importance_resample(docs.repartition(k), labels).collect()} for k in (1, 7)]
    assert weights[0] == pytest.approx(weights[1]) and len(set(weights[0].values())) > 5


def test_grams_stay_inside_texts():
    texts = [b"", b"a", b"stone river", b"ab\ncd" * 9]
    found, counts = quality.text_grams(texts)
    alone = [quality.gram_buckets(np.frombuffer(b"\n" + x + b"\n", np.uint8)).tolist() for x in texts]
    assert counts.tolist() == [len(x) for x in alone] and found.tolist() == sum(alone, [])


def test_clashing_column_names(spark):
    schema = "doc_id bigint, text string, source string, good boolean, copy string, mix_key string, wanted_source string, __words string, __n_lines string, __doc string, __t string, id bigint"
    one = spark.createDataFrame([(k, f"line {k}\nshared", "s", None, "c", "m", "w", "x", "n", "d", "t", 7) for k in range(4)], schema)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    assert quality.keep_good(spark, one, labels).columns == one.columns
    mixed = mixing.poisson_mix(one, seed=3)
    assert mixed.columns == [*one.columns, "copy_", "mix_key_"] and {r["copy"] for r in mixed.collect()} <= {"c"}
    lines = line_dedup.line_dedup(one, min_docs=3)
    assert {r["text"] for r in lines.collect()} == {f"line {k}" for k in range(4)} and {r["__n_lines_"] for r in lines.collect()} == {2} and {r["__words"] for r in lines.collect()} == {"x"}
    for out in (ngram_join.ngram_jaccard_join(one), substring_dedup.substring_dedup(one), lm_scoring.lm_scores(one, tokenizer_path()), packing.best_fit_packing(one, tokenizer_path())):
        assert out.count() == 4


def test_vectors_with_null_and_equal_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.02]), (None, [0.0, 1.0]), (4, [0.01, 1.0]), (None, [0.02, 1.0]), (None, [-1.0, -1.0]), (5, None)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in vector_dedup.vector_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (0, 2, 4, False), (4, 2, 4, True), (0, 2, 4, False), (0, 0, 0, True), (5, 0, 5, True)])


@pytest.mark.parametrize("keep_first", [False, True])
def test_substrings_of_documents_without_ids(spark, keep_first):
    passage = "".join(chr(97 + k) for k in np.random.default_rng(9).integers(0, 26, 260))
    rows = [(None, "x#" + passage), (3, passage + " y"), (None, "z" + passage), (3, "other %" + passage)]
    got = {bytes(r["kept"]).decode() for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), length=200, keep_first=keep_first).collect()}
    assert got >= ({"x#", "z"} if keep_first else {"x#", " y", "z", "other %"}) and len(got) == 4


def test_ranks_of_truncated_suffixes():
    data = np.frombuffer(b"banana bandana banana bandana!" * 3, np.uint8)
    for length in (1, 5, 8, 13, 30, 31):
        strings = [data[k : k + length].tobytes() for k in range(len(data) - length + 1)]
        place = {x: k for k, x in enumerate(sorted(set(strings)))}
        got = substring_dedup.truncated_ranks(data, length)
        assert np.unique(got, return_inverse=True)[1].tolist() == [place[x] for x in strings]


@pytest.mark.parametrize("table,column", [("parts", "payload"), ("recipes", "chunks"), ("recipes", "root"), ("manifest", "root")])
def test_a_store_that_was_tampered_with_fails(spark, docs, table, column):
    path = new_path(spark, "store")
    token_store.write_store(docs, path, tokenizer_path(), end_id=2)
    rows = spark.read.parquet(f"{path}/{table}")
    changed = {"payload": F.overlay("payload", F.lit(b"\x01"), F.lit(1)), "chunks": F.reverse(F.col("chunks")), "root": F.overlay("root", F.lit(b"\x01"), F.lit(1))}[column]
    other = new_path(spark, "store")
    for name in ("parts", "recipes", "manifest"):
        (rows.withColumn(column, changed) if name == table else spark.read.parquet(f"{path}/{name}")).write.parquet(f"{other}/{name}")
    with pytest.raises(Exception, match="doesn't hold document|manifest doesn't fit"):
        token_store.verified(spark, other).collect()


class FailingFiles:
    """A file system whose reads fail or fall short now and then, each place for the first time only."""

    def __init__(self, fs):
        self.fs, self.seen, self.failed = fs, set(), 0

    def open_input_file(self, path):
        inner, outer = self.fs.open_input_file(path), self

        class File:
            def read_at(self, size, offset):
                if (path, offset) not in outer.seen:
                    outer.seen.add((path, offset))
                    if len(outer.seen) % 3 == 0:
                        outer.failed += 1
                        raise OSError("lost")
                    if len(outer.seen) % 3 == 1:
                        outer.failed += 1
                        return inner.read_at(size // 2, offset)
                return inner.read_at(size, offset)

        return File()


def test_members_are_read_again_by_offset(spark, docs, monkeypatch):
    path = new_path(spark, "media")
    listed = media.write_archives(docs, path).collect()
    found, local = media._filesystem(path)
    failing = FailingFiles(found)
    monkeypatch.setattr(media, "_filesystem", lambda p: (failing, local))
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    reader = media.ArchiveReader({"path": path})
    got = {}
    for row in listed:
        for start in range(0, row["size"], 900):
            for batch in reader.read(media.Range(row["archive"], start, min(start + 900, row["size"]), row["size"])):
                for r in batch.to_pylist():
                    assert r["doc_id"] not in got
                    got[r["doc_id"]] = r["media"]
    assert failing.failed > 20 and {k: media.to_png(media.padded(t.encode())) for k, t in TEXTS.items()} == got


def brute_quality(rows, labels, noise):
    """Ids that the importance resampling keeps, from counts in dictionaries."""
    import collections

    def grams(t):
        b = b"\n" + (t or "").encode() + b"\n"
        out = []
        for k in range(len(b) - 3):
            h = 0
            for x in b[k : k + 4]:
                h = (h * 257 + x) & 0xFFFFFFFF
            out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
        return out

    good = {i for i, q in labels if q == 1}
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(grams(r["text"]))
        if r["doc_id"] in good:
            target.update(grams(r["text"]))
    share = sum(target.values()) / sum(raw.values())
    keys = [(r["doc_id"], sum(math.log(target[g] + 1) - math.log(raw[g] * share + 1) for g in grams(r["text"])) + noise[r["doc_id"]]) for r in rows]
    least = min(k for i, k in keys if i in good)  # under 500 good rows none may fall
    return [k >= least - 1e-9 for _, k in keys]


def brute_poisson(seed, doc, rate):
    u = int(hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    c = p
    while u >= c:
        k += 1
        p *= rate / k
        c += p
    return k


def test_pipeline_by_brute_force(spark, tmp_path):
    import collections

    import corpus_pipeline as cp

    rng = np.random.default_rng(15)
    say = lambda n: " ".join(rng.choice(WORDS, n)) + "\n" + " ".join(f"w{k}" for k in rng.integers(0, 500, n))
    texts = [("Common  line \n" if 5 < k < 22 else "") + say(int(rng.integers(3, 60))) for k in range(30)]
    texts += [t + " more" for t in texts[:8]] + [texts[3], texts[4], None, "", "zq#@!$ %^&*" * 20, "0101 " * 90] + [f"common  line\n{say(9)}" for _ in range(12)]
    docs = spark.createDataFrame([(None if k == 5 else k, t, "en", ["a", "b", "b", None][k % 4], None if t is None else len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = [(k, int(k % 3 != 0)) for k in range(0, 30)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    def staged(k, before):
        return cp.STAGES[k][1](spark, spark.createDataFrame(before, docs.schema), str(tmp_path)).collect()

    as_bag = lambda rows: collections.Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    rows = docs.collect()
    noise = {r["id"]: r["g"] for r in docs.select(F.col("doc_id").alias("id"), quality.gumbel(11, "doc_id").alias("g")).collect()}
    kept = [r for r, good in zip(rows, brute_quality(rows, labels, noise), strict=True) if good]
    one = staged(0, rows)
    assert as_bag(one) == as_bag(kept) and len(one) < len(rows)

    two = staged(1, one)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = collections.defaultdict(set)
    for r in one:
        for line in (r["text"] or "").split("\n"):
            holders[key(line)].add(r["doc_id"])
    common = {k for k, v in holders.items() if k and len(v) >= 10}
    seen, want = set(), []
    for r in sorted(one, key=lambda r: (r["doc_id"] is not None, r["doc_id"])):
        lines = []
        for line in (r["text"] or "").split("\n"):
            if key(line) not in common or key(line) not in seen:
                lines.append(line)
            seen.add(key(line))
        want.append((r["doc_id"], "\n".join(lines)))
    assert common and sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"] or "")) for r in two)

    three = staged(2, two)
    sets = [set(s.tolist()) for s in shingle_sets([(r["text"] or "").encode() for r in two], 5)]
    name = list(range(len(two)))
    for _ in name:
        for a in range(len(two)):
            for b in range(a):
                if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    groups = collections.defaultdict(list)
    for k, n in enumerate(name):
        groups[n].append(two[k]["doc_id"])
    firsts = {min((i is None, i or 0) for i in v) for v in groups.values()}
    assert {(r["doc_id"] is None, r["doc_id"] or 0) for r in three} == firsts and len(three) == len(groups) < len(two)

    four = staged(3, three)
    sizes = collections.Counter(r["source"] for r in three)
    want = collections.Counter()
    for r in three:
        copies = brute_poisson(17, r["doc_id"], len(three) / len(sizes) / sizes[r["source"]])
        if copies:
            want[r["doc_id"], r["text"], r["source"]] += copies
    assert as_bag(four) == want

    five = staged(4, four)
    places = collections.defaultdict(list)
    pieces = collections.Counter()
    for r in five:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"]] += 1
    assert pieces == collections.Counter((r["doc_id"], 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in four for ids in [[*ids_of(r["text"] or ""), 0]])
    for found in places.values():
        found.sort()
        assert all(b[0] == sum(n for _, n in found[:k]) for k, b in enumerate(found)) and sum(n for _, n in found) <= 2048
    total = sum(r["length"] for r in five)
    assert len(places) <= math.ceil(total / 2048) + 1
    assert len(cp.run(spark, str(tmp_path)).columns) == len(five[0])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_model_beats_the_baseline_on_held_out_documents(spark, sf, size):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', size)}/documents.parquet")
    base, score, words = lm_scoring.lm_scores(docs, tokenizer_path()).filter("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert score / words > base / words + 0.1


def test_replicas_are_averaged_in_tasks(spark, monkeypatch):
    """Any fan gives the weighted mean."""
    rng = np.random.default_rng(3)
    models = [{"E": rng.normal(size=(3, 2)).astype(np.float32), "b": rng.normal(size=4).astype(np.float32)} for _ in range(11)]
    weights = rng.integers(1, 9, 11).astype(float)
    df = spark.createDataFrame([(float(w), bytearray(lm_scoring._packed(m)), k) for k, (w, m) in enumerate(zip(weights, models, strict=True))], "weight double, params binary, replica bigint").repartition(4)
    for fan in (32, 3, 2):
        monkeypatch.setattr(lm_scoring, "FAN", fan)
        got = lm_scoring.averaged(df, 11)
        for k in ("E", "b"):
            assert np.allclose(got[k], np.average([m[k] for m in models], axis=0, weights=weights), atol=1e-6)


def test_equal_rows_are_learnt_from_and_scored_each_for_itself(spark):
    import collections

    rows = [(1, "aa bb cc", None), (1, "aa bb cc", None), (None, "aa dd", "x"), (None, "aa dd", "y"), (None, "aa dd", None), (2, None, None), (2, "", None), (5, "bb ee", None)]
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string, copies string").repartition(3), tokenizer_path()).collect()
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i in (1, 2, 5, None)}
    counts = collections.Counter()
    for i, t, _ in rows:
        if not held[i]:
            counts.update([*(t or "").split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*(t or "").split(), "\n"]), 9)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), round(r["base_score"], 9)) for r in got) == want and {r["train_tokens"] for r in got} == {n}
    assert len({r["score"] for r in got if r["doc_id"] is None}) == 1


@pytest.mark.parametrize("held", [200_000, 3, 1])
def test_common_lines_that_are_not_broadcast(spark, monkeypatch, held):
    """Lines of 40, 20, 9 and 3 documents, of which all, some or none are broadcast."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", held)
    sizes = {"aa": 40, "bb": 20, "cc": 20, "dd": 9, "ee": 3}
    rows = [(k, "\n".join([f"own {k}", *(w for w, n in sizes.items() if k < n)])) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, min_docs=9).collect()}
    assert got == {k: "\n".join([f"own {k}", *(["ee"] if k < 3 else [])]) for k in range(50)}
    first = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, min_docs=2, keep_first=True).collect()}
    assert first == {k: t if k == 0 else f"own {k}" for k, t in rows}


def test_many_rows_without_ids_in_a_store(spark, monkeypatch):
    """Repeated rows, null ids, and more documents than a segment."""
    monkeypatch.setattr(token_store, "SEGMENT", 16)
    rows = [(None, "same text"), (None, "same text"), (None, None), (7, "same text"), (7, "other")] * 20 + [(-3, "first with an id")]
    path = new_path(spark, "store")
    token_store.write_store(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), path, tokenizer_path(), end_id=2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.verified(spark, path).collect())
    sizes = lambda t: len(ids_of(t or "")) + 1
    assert [r[1] for r in got] == [None] * 60 + [-3] + [7] * 40
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False)) and sum(r[2] for r in got) == sum(sizes(t) for _, t in rows)
    assert {r[3] for r in got[60:61]} == {zlib.crc32(np.array([*ids_of("first with an id"), 2], "<u4").tobytes())}
    assert spark.read.parquet(f"{path}/manifest").count() == 7


def test_near_vectors_of_many(spark):
    """4,000 links planted in 6,000 vectors: recall of pairs just above the threshold, and none below it."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(2, 2000, 32))
    off -= (off * base).sum(2, keepdims=True) * base
    off /= np.linalg.norm(off, axis=2, keepdims=True)
    cos = rng.uniform(0.905, 0.93, (2, 2000, 1))
    near = cos * base + np.sqrt(1 - cos**2) * off
    vectors = np.concatenate([base, *near])
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(6)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.vector_dedup(df, threshold=0.9).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    exact = np.array([(unit[a : a + 500] @ unit.T >= 0.9).sum(1) - 1 for a in range(0, 6000, 500)]).ravel()
    found = np.array([got[k] for k in range(6000)])
    assert (found <= exact).all() and found.sum() >= 0.97 * exact.sum() and exact.sum() >= 8000
