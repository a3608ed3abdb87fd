"""The alignment of two tokenizers against loops over tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cellwright.llm import alignment
from cellwright.llm.common import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, it jumps. Over\nthe lazy dog.", "Donaudampfschifffahrtsgesellschaft überquert die Straße", None, "", " ", "  two  spaces\tand tabs\n\n\nlines ", "漢字とかな 😀👍🏽 naïve café",
    "a ▁ piece mark of the model", "<|endoftext|> and </s> <s> <unk> as text", "<0x41> is no byte", "x" * 3000, "word " * 50_000, "no break and wide", "\x00 zero and \x7f", "The quick brown fox, it jumps. Over\nthe lazy dog.",
    "U.S.A., e.g. this; i.e.that.", "\nfirst line feed", "12345 67,890.12 3.14", "aa\r\nbb\x0bcc",
]


def spelled(a, b):
    shown = [x for r in (range(33, 127), range(161, 173), range(174, 256)) for x in r]
    char = {chr(x): x for x in shown}
    char.update((chr(256 + k), x) for k, x in enumerate(x for x in range(256) if x not in shown))
    return (
        lambda k: bytes(char[c] for c in a.id_to_token(k)),
        lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode(),
    )


def brute(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    say_a, say_b = spelled(a, b)
    rows, corpus = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(map(say_a, ids[0])) != want or b"".join(map(say_b, ids[1])) != want:
            rows.append(((0, 0, 0, 0), Counter(), ""))
            continue
        ends = [np.cumsum([len(say(k)) for k in own]).tolist() for own, say in zip(ids, (say_a, say_b), strict=True)]
        pairs = Counter()
        spans = [[(x, y, k) for x, y, k in zip([0, *e], e, own, strict=False)] for e, own in zip(ends, ids, strict=True)]
        for x, y, p in spans[0]:
            pairs.update((p, q) for u, v, q in spans[1] if max(x, u) < min(y, v))
        groups, x, y = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, ids[0][x:p])) + "|" + ",".join(map(str, ids[1][y:q])))
            x, y = p, q
        corpus.update(pairs.keys())
        rows.append(((len(ids[0]), len(ids[1]), len(groups), sum(pairs.values())), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (p, _), n in corpus.items():
        best[p] = max(n, best.get(p, 0))
    return [(*sizes, sum(n for p, n in pairs.items() if corpus[p] == best[p[0]]), sum(n * corpus[p] for p, n in pairs.items()), digest) for sizes, pairs, digest in rows]


@pytest.fixture(scope="module")
def wanted():
    short = [t for t in TEXTS if not t or len(t) < 100_000]
    return short, brute(short)


def rows_of(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 10])
def test_rows_equal_a_loop(spark, wanted, held):
    """Also where only the ten most frequent pairs' counts are sent to the tasks and all others are joined."""
    texts, want = wanted
    docs = spark.createDataFrame([(k, t, "r") for k, t in enumerate(texts)], "doc_id bigint, text string, row string").repartition(3)
    got = rows_of(alignment.cross_tokenizer_alignment(docs, A, B, held_pairs=held))
    assert [got[k] for k in range(len(texts))] == want
    zero = [k for k, w in enumerate(want) if not w[0]]
    assert [texts[k] for k in zero if texts[k]] == ["a ▁ piece mark of the model"]


def test_long_text_is_encoded_as_by_the_tokenizers(spark):
    text = TEXTS[11]
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    docs = spark.createDataFrame([(None, text), (None, text), (1, "short")], "doc_id bigint, text string")
    got = alignment.cross_tokenizer_alignment(docs, A, B).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["n_b"]) for r in got)[:2] == [(0, len(a.encode(" " + text).ids), len(b.encode(text)))] * 2


def test_documents_of_the_table_are_encoded_as_by_the_tokenizers(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r[0]]
    own = alignment.aligner(A, B)
    ids_a, ids_b = own.encoded([t.encode() for t in texts])
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    assert ids_a.to_pylist() == [x.ids for x in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert ids_b.to_pylist() == b.encode(texts, num_threads=1)


def test_empty_table(spark):
    assert alignment.cross_tokenizer_alignment(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0
