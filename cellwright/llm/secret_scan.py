"""Secrets: what plain patterns find, and tokens of the formats that the found ones have.

The patterns' finds are the labelled credentials of three kinds.  From a bounded sample of each kind a probabilistic automaton is inferred
(``automata``), and one from ordinary tokens.  Every other long token of every text that has letters and digits is then scored: the log
probability that a kind's automaton gives it less that of the ordinary one.  A token is added where that is by character no less than what nearly all
credentials have that the automata were not inferred from, and in all at least EVIDENCE: of tokens as the ordinary automaton makes them,
a share of exp(-EVIDENCE) at most comes so far.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.automata import Automaton, infer
from cellwright.llm.common import lean, small_batches, stash

KINDS = ["assign", "access", "hex", "format"]
ORDINARY = "ordinary"
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
#: A text without one of these has no assignment.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ASSIGN_LEAST = 6
#: Runs are maximal, so the least lengths may stand in the patterns.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Candidates: long runs of what credentials are made of.
TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}")
MIXED = re.compile(rb"[A-Za-z][+/_.=-]*[0-9]|[0-9][+/_.=-]*[A-Za-z]")
#: Distinct examples of a kind, and ordinary tokens, that automata are inferred from, at most; those with the least hashes.
FIT_ROWS = 4_000
#: A kind with fewer distinct examples has no automaton.
FEWEST = 20
#: Longer examples aren't learned from.
LONGEST = 256
#: Share of the credentials kept aside that may score lower than the limit.
LOSS = 0.05
#: The least score by character, and of a whole token, in nats, whatever the examples say.
LEAST_SCORE, EVIDENCE = 0.5, 14.0
#: Times that the ordinary automaton is inferred at most.
ROUNDS = 8


def base_matches(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes of all matches of the three patterns, by start, then kind.

    A failing assignment (a value of under 6 characters) is left out, but what it covers isn't looked at again.
    """
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out.append((m.start(), 0, m.end(), m.start(2)))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        out.extend((m.start(), kind, m.end(), m.start()) for m in pattern.finditer(text))
    return sorted(out)


def candidates(text: bytes, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the long tokens that no match of a pattern touches."""
    out = []
    k = reach = 0
    for m in TOKEN.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def _gatherer(most: int):
    """Of each kind a partition's distinct examples with the least hashes: kind, value, hash."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {k: {} for k in (*KINDS[:3], ORDINARY)}

        def cut(own: dict[bytes, int]) -> dict[bytes, int]:
            return dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:most])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_matches(text)
                found = [(KINDS[kind], text[value:end]) for _, kind, end, value in base if end - value <= LONGEST]
                found += [(ORDINARY, text[a:b]) for a, b in candidates(text, base) if b - a <= LONGEST]
                for kind, value in found:
                    own = held[kind]
                    if value not in own:
                        own[value] = xxhash.xxh3_64_intdigest(value) >> 1
                        if len(own) > 4 * most:
                            held[kind] = cut(own)
        rows = [(kind, value, h) for kind, own in held.items() for value, h in cut(own).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "value", "hash"])

    return run


def examples(docs: DataFrame, text_col: str, fit_rows: int) -> dict[str, list[bytes]]:
    """Up to ``fit_rows`` distinct values of each kind, over all documents, in order of their hashes; so they don't depend on partitions."""
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    # written once: the four kinds would each read all documents
    found = stash(texts.mapInArrow(_gatherer(fit_rows), "kind string, value binary, hash bigint"), "secret-examples").distinct()
    sample = None
    for kind in (*KINDS[:3], ORDINARY):
        part = found.filter(F.col("kind") == kind).orderBy("hash", "value").limit(fit_rows)
        sample = part if sample is None else sample.unionByName(part)
    out: dict[str, list[tuple[int, bytes]]] = {k: [] for k in (*KINDS[:3], ORDINARY)}
    for row in sample.collect():
        out[row["kind"]].append((row["hash"], bytes(row["value"])))
    return {k: [v for _, v in sorted(x)] for k, x in out.items()}


class Format(NamedTuple):
    """A kind's automaton, and the score by character from which a token is of its format."""

    kind: str
    automaton: Automaton
    limit: float


def margin(kind: Automaton, ordinary: Automaton, texts: list[bytes]) -> np.ndarray:
    """By character: how much more likely the texts are by the kind's automaton."""
    sizes = np.maximum(1, np.fromiter(map(len, texts), float, len(texts)))
    return (kind.scores(texts) - ordinary.scores(texts)) / sizes


def learned(found: dict[str, list[bytes]]) -> tuple[Automaton, list[Format]]:
    """The automaton of ordinary tokens, and the formats: inferred from one half of the examples, limits from the other.

    Values of under 16 characters are no candidates and aren't learned from.  Ordinary tokens hold unlabelled credentials too: those that a
    format told apart from ordinary tokens explains better are left out, and the ordinary automaton is inferred again.
    """
    kinds = {k: [x for x in found[k] if len(x) >= 16] for k in KINDS[:3]}
    kinds = {k: (infer([(x, 1) for x in own[::2]]), own[1::2]) for k, own in kinds.items() if len(own) >= FEWEST}
    plain = found[ORDINARY]
    for _ in range(ROUNDS):
        ordinary = infer([(x, 1) for x in plain])
        low = {k: float(np.quantile(margin(automaton, ordinary, aside), LOSS)) for k, (automaton, aside) in kinds.items()}
        explained = np.zeros(len(plain), bool)
        for k, (automaton, _) in kinds.items():
            if low[k] > 0:
                explained |= margin(automaton, ordinary, plain) >= low[k]
        if not explained.any():
            break
        plain = [x for x, e in zip(plain, explained.tolist(), strict=True) if not e]
    return ordinary, [Format(k, automaton, max(low[k], LEAST_SCORE)) for k, (automaton, _) in kinds.items()]


def passed_by(form: Format, ordinary: Automaton, texts: list[bytes]) -> np.ndarray:
    """By how much, by character, each text passes the limits of a format."""
    own = margin(form.automaton, ordinary, texts)
    return own - np.maximum(form.limit, EVIDENCE / np.fromiter(map(len, texts), float, len(texts)))


def _code_points(text: bytes, places: list[int]) -> list[int]:
    if text.isascii():
        return places
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return before[places].tolist()


def _scanner(model, id_type: pa.DataType):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, formats = model.value
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            bases = [base_matches(x) for x in texts]
            spans = [[(a, kind, b) for a, kind, b, _ in base] for base in bases]
            owner, where, tokens = [], [], []
            for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
                for a, b in candidates(text, base):
                    if not MIXED.search(text, a, b):
                        continue
                    owner.append(k)
                    where.append((a, b))
                    tokens.append(text[a:b])
            best = np.full(len(texts), -np.inf)
            if tokens and formats:
                over = np.stack([passed_by(f, ordinary, tokens) for f in formats]).max(0)
                np.maximum.at(best, owner, over)
                for k in np.flatnonzero(over > 0).tolist():
                    spans[owner[k]].append((where[k][0], 3, where[k][1]))
            said, base_said = [], []
            for text, own in zip(texts, spans, strict=True):
                own.sort()
                places = _code_points(text, [p for a, _, b in own for p in (a, b)])
                words = [(kind, f"{KINDS[kind]}:{places[2 * k]}:{places[2 * k + 1]}") for k, (_, kind, _) in enumerate(own)]
                said.append(",".join(w for _, w in words))
                base_said.append(hashlib.sha256(",".join(w for kind, w in words if kind < 3).encode()).hexdigest())
            counts = [[sum(kind == k for _, kind, _ in own) for own in spans] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_said, pa.string()), pa.array(said, pa.string()), pa.array([None if x == -np.inf else x for x in best.tolist()], pa.float64())],
                names=["id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans", "best_margin"],
            )

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: id_col, n_assign, n_access, n_hex, n_format, base_sha256, spans, best_margin.

    ``spans``: kind:start:end by start, then kind, comma-joined, in code points, end exclusive; ``base_sha256`` is that of the patterns'
    spans alone.  ``best_margin`` is by how much the document's best candidate passes a format's limits (null without a candidate or a format).
    Null and empty texts have no spans.  Rows are scanned one by one, so null and repeated ids keep rows of their own; equal texts have equal
    spans.  Other columns don't matter, and an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(learned(examples(docs, text_col, fit_rows)))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = own.schema["id"].dataType
    scanned = own.mapInArrow(_scanner(model, to_arrow_type(kind)), f"id {kind.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, n_format bigint, base_sha256 string, spans string, best_margin double")
    return scanned.withColumnRenamed("id", id_col)
