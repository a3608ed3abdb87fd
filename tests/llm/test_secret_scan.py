"""Secret scans against plain patterns, and automata against the languages they are learned from."""

import hashlib
import random
import re

import numpy as np
import pytest

from cellwright.llm import automata, secret_scan

HEXA = "0123456789abcdef"


def credentials(seed, n, length=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(HEXA) for _ in range(length)) for _ in range(n)]


TEXTS = [
    'a token = "' + credentials(1, 1)[0] + '" é', "API_KEY: 'abc/def+12=' APIkey=short", None, "", "PASSWORD=token=abcdefgh secret=token: abcdefgh", "é漢 AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 15, "AKIA" + "C" * 15,
    "x" * 5 + HEXA * 2 + "g" + "0" * 23 + " ſecret=abcdefgh toKen=abcdefgh", 'passwd" : "ab.cd_ef-"' * 3, "word " * 20_000 + "secret: " + "9" * 30,
]


def brute(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(k == want for _, k, _ in found) for want in range(3)], hashlib.sha256(said.encode()).hexdigest(), said


def table(spark, texts, parts=3):
    return spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, spans string").repartition(parts)


def test_base_spans_equal_the_patterns(spark):
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(table(spark, TEXTS)).collect()}
    for k, text in enumerate(TEXTS):
        counts, digest, said = brute(text)
        assert ([got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]], got[k]["base_sha256"], got[k]["spans"]) == (counts, digest, said)
        assert got[k]["n_format"] == 0  # too few examples to learn from


def test_base_spans_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    for r in secret_scan.secret_scan(docs).collect():
        counts, digest, said = brute(texts[r["doc_id"]])
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) == (counts, digest)
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))


def test_formats_of_found_credentials_find_others(spark):
    """Hex keys of 40 digits are labelled by their assignments; hex runs of 22 digits aren't found by any pattern."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(16, 24))) for _ in range(400)] + [f"docs/chapter-{k}/page-{k * 7}.html" for k in range(200)]
    texts = [f'{w} token = "{c}" end' for w, c in zip(words, credentials(2, len(words)), strict=True)]
    hidden = ["key " + c[:22] + " here" for c in credentials(3, 50)]
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(table(spark, [*texts, *hidden])).collect()}
    assert all("format" not in got[k]["spans"] and got[k]["n_format"] == 0 for k in range(len(texts)))
    caught = [got[len(texts) + k] for k in range(len(hidden))]
    assert sum(r["spans"] == "format:4:26" for r in caught) >= 40


def test_rows_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [sorted(map(tuple, secret_scan.secret_scan(docs.repartition(n)).drop("best_margin").collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_empty_table_and_repeated_rows(spark):
    assert secret_scan.secret_scan(table(spark, [])).count() == 0
    same = spark.createDataFrame([(None, TEXTS[0])] * 3, "doc_id bigint, text string")
    got = secret_scan.secret_scan(same).collect()
    assert len(got) == 3 and len({r["spans"] for r in got}) == 1


def test_automaton_of_a_loop_has_few_states():
    """Digits in pairs, then a mark: (dd-)*dd.  Its states are found whatever the lengths."""
    rng = random.Random(3)
    
    def pairs():
        yield f"{rng.randint(0, 99):02d}"
        while rng.random() < 0.7:
            yield f"{rng.randint(0, 99):02d}"

    own = ["-".join(pairs()).encode() for _ in range(2000)]
    found = automata.infer([(x, 1) for x in own])
    assert len(found) <= 6
    good, bad = found.scores([b"12-34-56-78-90-12-34"]), found.scores([b"123-4-567-89-0-1234-"])
    assert good[0] > bad[0] + 10


def test_probabilities_of_an_automaton():
    own = [(b"ab", 3), (b"a", 1), (b"zz9", 2)]
    found = automata.infer(own)
    whole = [c.encode() for c in "".join(automata.CLASSES)]
    # what the first state gives: every character, other bytes and the end sum to one
    first = np.exp(found.log[0]).sum() + np.exp(found.log_end[0])
    assert first == pytest.approx(1)
    one = np.exp(found.scores([b"", *whole]))
    assert one.sum() < 1 and found.scores([b"ab"])[0] > found.scores([b"9-"])[0]


def test_inference_does_not_depend_on_order():
    own = [(c.encode(), 1) for c in credentials(8, 300, 24)]
    a, b = automata.infer(own), automata.infer(own[::-1])
    assert np.array_equal(a.next, b.next) and np.array_equal(a.log, b.log) and len(a) < 40
