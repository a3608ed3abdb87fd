"""Alignment of two tokenizers over the same bytes.

Every text is encoded by a byte-level BPE (A) and a piece model (B) whose tokens spell the same bytes.  Within a task all is
Arrow: the id lists are flattened with their parents' indices, byte lengths are taken by id and summed up within each document, and
a hash join on (document, end) finds where both tokenizers cut.  Between two ends that follow each other, whoever's they are, one
A and one B token overlap, so the joined rows in order are the links.  Counts of id pairs by document are grouped in the
task and merged by Spark; a second pass over the documents' own pairs looks the corpus's counts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.common import lean, small_batches, stash
from cellwright.llm.tokens import Encoder, slices

#: Bytes of text that are encoded and aligned at once.
SLICE_BYTES = 1_000_000
#: Texts longer than this are encoded whole.
LONG_TEXT = 200_000
#: Pairs whose counts every worker may hold (24 bytes each).  Rarer pairs beyond them are joined.
HELD_PAIRS = 2_000_000
#: Partial counts that a task gathers before it sends them.
GATHERED = 1_000_000
SHIFT = 32
_KEPT: dict[tuple[str, str], Aligner] = {}


class ByteEncoder(Encoder):
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = None

    def spelled(self) -> pa.Array:
        """The bytes of every id: characters of the vocabulary stand for bytes."""
        shown = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
        char = {chr(b): b for b in shown}
        char.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in set(shown)))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        return pa.array([bytes(char[c] for c in x) if all(c in char for c in x) else x.encode() for x in names], pa.binary())


class PieceEncoder(Encoder):
    """A sentencepiece model without its own leading space.

    It is fed the same pieces of texts as the other one, cut before single spaces, around single line feeds, and before a comma
    or full stop after a letter; a model with an entry across such a cut is refused, and then all texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.pieces = pieces
        across = any("▁" in x.lstrip("▁") or "\n" in x for x in pieces) or any(a.isascii() and a.isalpha() and b in ",." for x in pieces for a, b in zip(x, x[1:], strict=False))
        self.whole_only = across or spec.name != "identity" or spec.remove_extra_whitespaces
        self.added = None
        from cellwright.llm.tokens import Hasher

        self.hasher = Hasher()
        self._forget()

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(pieces, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((k for x in found for k in x), np.uint32, int(sizes.sum())), sizes

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text, num_threads=1), np.uint32)

    def spelled(self) -> pa.Array:
        """The bytes of every id: U+2581 is a space, <0xHH> a byte."""
        out = []
        for k, x in enumerate(self.pieces):
            out.append(bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode())
        return pa.array(out, pa.binary())


def ids_of(own: Encoder, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each text has.  Long texts, and those with white space beyond ASCII, are encoded whole."""
    from cellwright.llm.tokens import _WIDE_SPACE

    everything = getattr(own, "whole_only", False)
    odd = {k: own.whole(x.decode()) for k, x in enumerate(texts) if x and (everything or len(x) > LONG_TEXT or (not x.isascii() and _WIDE_SPACE.search(x.decode())))}
    flat, counts = own.encode([b"" if k in odd else x for k, x in enumerate(texts)])
    if not odd:
        return flat, counts
    parts = np.split(flat, np.cumsum(counts)[:-1])
    for k, ids in odd.items():
        parts[k], counts[k] = ids, len(ids)
    return np.concatenate(parts), counts


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


class Aligner:
    """Both tokenizers of a worker, and what their ids spell."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteEncoder(path_a), PieceEncoder(path_b)
        self.bytes_a, self.bytes_b = self.a.spelled(), self.b.spelled()
        self.len_a, self.len_b = (pc.binary_length(x).cast(pa.int64()) for x in (self.bytes_a, self.bytes_b))
        name_a, name_b = ([str(k) for k in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        #: an id and what follows it: A inside a group, A last of its side, B inside, B last of a group, B last of a document
        self.words = pa.array([x + "," for x in name_a] + [x + "|" for x in name_a] + [x + "," for x in name_b] + [x + ";" for x in name_b] + name_b, pa.string())

    def encoded(self, texts: list[bytes]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids by A and by B of a space and the text; none where the text is empty or one of them spells other bytes."""
        spaced = [b" " + x if x else b"" for x in texts]
        sides = []
        wrong = np.zeros(len(texts), bool)
        whole = b"".join(spaced)
        size = np.fromiter(map(len, spaced), np.int64, len(spaced))
        for own, spelled, length in ((self.a, self.bytes_a, self.len_a), (self.b, self.bytes_b, self.len_b)):
            flat, counts = ids_of(own, spaced)
            ids = pa.array(flat, pa.int32())
            buffer = spelled.take(ids).buffers()[2]
            said = b"" if buffer is None else buffer.to_pybytes()
            if said[: len(whole)] != whole or len(pc.take(length, ids)) and pc.sum(pc.take(length, ids)).as_py() != len(whole):
                ends = np.concatenate([[0], np.cumsum(pc.take(length, ids).to_numpy())])[np.concatenate([[0], np.cumsum(counts)])]
                wrong |= np.array([said[x:y] != t for x, y, t in zip(ends[:-1].tolist(), ends[1:].tolist(), spaced, strict=True)], bool)
            sides.append((flat, counts))
        wrong |= size == 0
        if wrong.any():
            sides = [(flat[~np.repeat(wrong, counts)], np.where(wrong, 0, counts)) for flat, counts in sides]
        return _lists(*sides[0]), _lists(*sides[1])


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner."""
    if (path_a, path_b) not in _KEPT:
        _KEPT[path_a, path_b] = Aligner(path_a, path_b)
    return _KEPT[path_a, path_b]


def token_ends(ids: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """doc, end (bytes of the document up to the token's end) and the id, of all tokens in order."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.take(lengths, flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), upto])
    base = pc.take(before, ids.offsets.slice(0, len(ids)))  # bytes of all documents before
    return pa.table({"doc": doc, "end": pc.subtract(upto, pc.take(base, doc)), name: flat})


def ends_in_order(ids_a: pa.ListArray, ids_b: pa.ListArray, len_a: pa.Array, len_b: pa.Array) -> pa.Table:
    """doc, end, a, b: every end of a token of either side, in order, with the ids that end there."""
    joined = token_ends(ids_a, len_a, "a").join(token_ends(ids_b, len_b, "b"), ["doc", "end"], join_type="full outer", use_threads=False)
    return joined.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()


def links(ends: pa.Table) -> pa.Table:
    """doc, pair (A's id, then 32 bits of B's): all overlaps of an A and a B token, in order.

    The bytes up to an end belong to the tokens that end there or next; both sides end where a document does.
    """
    a, b = (pc.fill_null_backward(ends.column(c)).cast(pa.int64()) for c in ("a", "b"))
    return pa.table({"doc": ends.column("doc"), "pair": pc.bit_wise_or(pc.shift_left(a, pa.scalar(SHIFT, pa.int64())), b)})


def _numpy(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def group_digests(ends: pa.Table, n_docs: int, words: pa.Array, size_a: int, size_b: int) -> tuple[np.ndarray, list[str]]:
    """Groups of each document, and the SHA-256 of their ids as text ('' without tokens)."""
    doc = _numpy(ends.column("doc")).astype(np.int64)
    is_a, is_b = _numpy(ends.column("a").is_valid()), _numpy(ends.column("b").is_valid())
    shared = is_a & is_b
    n_groups = np.bincount(doc[shared], minlength=n_docs)
    if not len(doc):
        return n_groups, [""] * n_docs
    group = np.cumsum(shared) - shared
    ga, gb = group[is_a], group[is_b]
    n = int(group[-1]) + 1
    in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
    last_row = np.append(doc[1:] != doc[:-1], True)
    code = np.empty(len(ga) + len(gb), np.int64)
    code[np.arange(len(ga)) + before_b[ga]] = _numpy(ends.column("a").drop_null()) + np.where(shared[is_a], size_a, 0)
    kind = np.where(last_row[is_b], 2, np.where(shared[is_b], 1, 0))
    code[np.arange(len(gb)) + upto_a[gb]] = _numpy(ends.column("b").drop_null()) + 2 * size_a + kind * size_b
    said = words.take(pa.array(code))
    offsets = np.frombuffer(said.buffers()[1], np.int32, len(said) + 1)
    tokens = np.bincount(doc[is_a], minlength=n_docs) + np.bincount(doc[is_b], minlength=n_docs)
    edge = offsets[np.concatenate([[0], np.cumsum(tokens)])].tolist()
    raw = memoryview(said.buffers()[2])
    return n_groups, [hashlib.sha256(raw[x:y]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:], strict=True)]


def _count_of(docs: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.bincount(docs, minlength=n), pa.int64())


def _align(path_a: str, path_b: str, id_type: pa.DataType):
    names = ["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "pair", "n"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        first = TaskContext.get().partitionId() << 36
        partial: list[pa.Table] = []
        held = 0

        def sent() -> pa.RecordBatch:
            """Numbers of documents by pair, as rows without an id."""
            whole = pa.concat_tables(partial).group_by("pair", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            empty = [pa.nulls(len(whole), t) for t in (id_type, *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
            partial.clear()
            return pa.RecordBatch.from_arrays([*empty, *(whole.column(c).combine_chunks().cast(pa.int64()) for c in ("pair", "n_sum"))], names=names)

        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for x, y in slices([len(t) for t in texts], SLICE_BYTES):
                n = y - x
                ids_a, ids_b = own.encoded(texts[x:y])
                ends = ends_in_order(ids_a, ids_b, own.len_a, own.len_b)
                linked = links(ends)
                distinct = linked.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
                counted = distinct.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"])
                partial.append(counted)
                held += len(counted)
                n_groups, digests = group_digests(ends, n, own.words, len(own.bytes_a), len(own.bytes_b))
                doc = _numpy(distinct.column("doc"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(x, n).cast(id_type),
                        pa.array(np.arange(first, first + n)),
                        pc.list_value_length(ids_a).cast(pa.int64()),
                        pc.list_value_length(ids_b).cast(pa.int64()),
                        pa.array(n_groups, pa.int64()),
                        _count_of(_numpy(linked.column("doc")), n),
                        pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(_numpy(distinct.column("pair")))),
                        pa.ListArray.from_arrays(offsets, pa.array(_numpy(distinct.column("count_all")).astype(np.int32))),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                    ],
                    names=names,
                )
                first += n
                if held > GATHERED:
                    yield sent()
                    held = 0
        if partial:
            yield sent()

    return run


def _looked_up(held, id_type: pa.DataType):
    """Sums over a document's links whose pairs are held; the other pairs stay with it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = held.value
        for batch in batches:
            pairs, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times"))
            flat, doc, n_times = (_numpy(x) for x in (pc.list_flatten(pairs), pc.list_parent_indices(pairs), pc.list_flatten(times)))
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            n = batch.num_rows
            sums = np.zeros((2, n), np.int64)
            if known.any():
                d, w = doc[known], n_times[known].astype(np.int64)
                start = np.flatnonzero(np.diff(d, prepend=-1))
                for k, x in enumerate((w * best[at[known]], w * counts[at[known]])):
                    sums[k, d[start]] = np.add.reduceat(x, start)
            rest = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=n))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~known])) for x in (flat, n_times)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], pa.array(sums[0]), pa.array(sums[1]), *left], names=["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"]
            )

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (whether no pair of the same A id is in more); an A id has no more pairs than B has ids."""
    counts = aligned.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    by_a = Window.partitionBy(F.shiftright("pair", SHIFT))
    return counts.withColumn("best", F.col("n") == F.max("n").over(by_a))


def held_from(counts: DataFrame, most: int) -> int:
    """The least power of two with at most ``most`` pairs in so many documents; 0 if all pairs are that few."""
    sizes = {r["e"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("c")).collect()}  # 64 rows at most
    total = 0
    for e in sorted(sizes, reverse=True):
        total += sizes[e]
        if total > most:
            return 1 << (e + 1)
    return 0


def cross_tokenizer_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", held_pairs: int = HELD_PAIRS) -> DataFrame:
    """Per document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that a tokenizer can't spell, have no tokens: zeros and ''.  Repeated rows and null ids are
    documents of their own.  An empty table gives no rows; other columns don't matter.  The counts of up to ``held_pairs`` pairs, the most
    frequent ones, are sent to all tasks; all others are joined, and none of those is frequent.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind, arrow = own.schema["id"].dataType.simpleString(), to_arrow_type(own.schema["id"].dataType)
    head = f"id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    aligned = stash(own.mapInArrow(_align(path_a, path_b, arrow), f"{head}, pairs array<bigint>, times array<int>, pair bigint, n bigint"), "aligned")
    counts = stash(pair_counts(aligned), "pair-counts")
    least = held_from(counts, held_pairs)
    known = counts.filter(F.col("n") >= least).toPandas()  # held_pairs rows at most
    known = known.sort_values("pair")
    held = spark.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(np.int64)))
    rows = aligned.filter("row is not null").select("id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    summed = rows.mapInArrow(_looked_up(held, arrow), f"{head}, n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>")
    if least:
        summed = stash(summed, "alignment-sums")
        one = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
        rare = counts.filter(F.col("n") < least)
        found = one.join(rare, one["pairs"] == rare["pair"]).groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        summed = summed.join(found, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return summed.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
