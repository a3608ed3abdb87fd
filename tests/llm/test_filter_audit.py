"""The filter audit against a loop over documents and orders."""

import re
from itertools import permutations

import numpy as np
import pytest

from cellwright.llm import filter_audit

WORDS = " ".join(f"w{k}" for k in range(60))
DOCS = [
    (1, WORDS, "a"), (2, WORDS, "a"), (3, WORDS, "b"), (3, WORDS, "b"), (0, "short", None), (9, None, ""), (8, "", "a"), (None, "short", "a"),
    (None, WORDS + " x", "a"), (None, WORDS + " x", "a"), (4, WORDS + " x", "b"), (5, "x " * 80, "b"), (6, "A B C é " * 20, "b"), (6, "50 % | # " * 5, "a"),
    (7, WORDS + " tail\x0bz", "c"), (11, "long " * 5000, "c"), (12, "long " * 5000, "c"),
]
LABELS = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (5, None, 1), (None, 1, 1), (12, 1, 1)]


def brute(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)}
        fails |= {"D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        rows.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for _, fails, _, _ in own:
                hit = next((f for f in order if f in fails), None)
                if hit:
                    shapley[hit] += 1
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                left = [r for r in own if not r[1] & before]
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                out[part, "".join(order), k + 1] = (len(left) - len(gone), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), shapley[f])
    return out


def tables(spark, docs, labels, parts=3):
    return (
        spark.createDataFrame([(*d, 7) for d in docs], "doc_id bigint, text string, source string, mask int").repartition(parts),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


@pytest.mark.parametrize("sketch_bytes", [filter_audit.SKETCH_BYTES, 1])
def test_counts_equal_a_loop(spark, sketch_bytes):
    """Also with a sketch so small that nearly every text is compared in full."""
    got = filter_audit.filter_audit(*tables(spark, DOCS, LABELS), sketch_bytes=sketch_bytes).collect()
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert found == brute(DOCS, LABELS)


def test_no_documents_and_no_labels(spark):
    assert filter_audit.filter_audit(*tables(spark, [], [])).count() == 0
    got = filter_audit.filter_audit(*tables(spark, DOCS, []))
    assert got.agg({"good_lost": "max"}).first()[0] == 0 and got.count() == 600 * 4


def test_sketch_clears_no_repeated_text(spark):
    texts = [f"text {k % 900}".encode() for k in range(1000)]
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary").repartition(5)
    bits = filter_audit.repeat_sketch(df, 1000)
    maybe = filter_audit.may_repeat(filter_audit.text_hashes(texts), bits)
    assert maybe[:100].all() and maybe[900:].all() and maybe[100:900].mean() < 0.05
    assert np.array_equal(bits, filter_audit.repeat_sketch(df.repartition(2), 1000))


def test_a_group_of_equal_texts_in_many_tasks(spark):
    docs = [(k, WORDS if k % 3 else f"{WORDS} {k}", "a") for k in range(3000)]
    got = filter_audit.masks(*tables(spark, docs, [], 40)).collect()
    assert sorted((r["mask"], r["n"]) for r in got) == [(0, 1001), (16, 1999)]
