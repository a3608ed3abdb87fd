"""Line deduplication with per-document keep bitmaps.

Line hashes are range-partitioned by (hash, document) with a secondary sort by position, so
one pass over each sorted run sees every document's first occurrence of a line, and a line
that a third of all documents hold is spread over many ranges.  Per-line document counts
are pre-aggregated inside the runs before they are shuffled.  What comes back for a document is a
sparse bitmap of 64-line words; text is joined to it only at the end.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import SPACES, ascii_lower, free_name, stash, text_of

WORD = 64
#: Common lines up to which their hashes are broadcast (16 bytes each, and what a hash table takes); beyond they are joined by key.
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends; A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_runs(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each (line, document): line hash h1, h2, doc, positions (pos, t: hash of the text) ascending.

    128 hash bits identify a line key.
    """
    # in a select of its own: beside the generator a text would be hashed once for each of its lines
    hashed_texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text"))
    lines = hashed_texts.select("doc", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "t", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "pos", "t")
    sorted_runs = hashed.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    return sorted_runs.groupBy("h1", "h2", "doc").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("positions"))


def drop_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc, t (hash of the text), words: array of (word, keep) for the 64-line words in which some line goes.

    Bit i of keep is set if line 64 * word + i stays; words that are not listed stay whole.
    A line goes if at least ``min_docs`` documents hold its key; with ``keep_first`` the first
    occurrence by (document, position) stays, and repeats inside one document count as well.
    """
    runs = stash(line_runs(docs, id_col, text_col, min_chars), "line-runs")
    totals = runs.groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("positions")).alias("n_lines"),
        F.min(F.struct("doc", F.element_at("positions", 1).alias("at"))).alias("first"),
    )
    if keep_first:
        common = totals.filter((F.col("n_docs") >= min_docs) & (F.col("n_lines") > 1)).select("h1", "h2", "n_docs", "first")
        hit = _joined(runs, common).select("doc", F.explode("positions").alias("at"), "first")
        gone = hit.filter(~F.col("doc").eqNullSafe(F.col("first.doc")) | (F.col("at") != F.col("first.at"))).select("doc", "at.t", "at.pos")
    else:
        common = totals.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "n_docs")
        gone = _joined(runs, common).select("doc", F.explode("positions").alias("at")).select("doc", "at.t", "at.pos")
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    words = gone.select("doc", "t", F.expr(f"cast(pos div {WORD} as int)").alias("word"), bit.alias("bit")).groupBy("doc", "t", "word").agg(F.bitwise_not(F.bit_or("bit")).alias("keep"))
    return words.groupBy("doc", "t").agg(F.array_sort(F.collect_list(F.struct("word", "keep"))).alias("words"))


def _joined(runs: DataFrame, common: DataFrame) -> DataFrame:
    """The runs of common lines (n_docs).  The lines of most documents, BROADCAST_LINES at most, are broadcast, so that a very common line's runs need not meet in one task;
    all others, if there are more, are joined, and none of those is in more documents than the broadcast ones.
    """
    written = stash(common, "common-lines")
    sizes = {r["e"]: r["c"] for r in written.groupBy((F.length(F.bin("n_docs")) - 1).alias("e")).agg(F.count("*").alias("c")).collect()}  # a row for each power of two
    least, held = 0, 0
    for e in sorted(sizes, reverse=True):
        held += sizes[e]
        if held > BROADCAST_LINES:
            least = 1 << (e + 1)
            break
    out = runs.join(F.broadcast(written.filter(F.col("n_docs") >= least)), ["h1", "h2"])
    return out.unionByName(runs.join(written.filter(F.col("n_docs") < least), ["h1", "h2"])) if least else out


def dropped_positions(words: Column) -> Column:
    """The line numbers whose bits are cleared."""
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))
    one = lambda w: F.transform(
        F.filter(bits, lambda b: F.getbit(w["keep"], b) == 0), lambda b: w["word"] * WORD + b
    )
    return F.flatten(F.transform(words, one))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with ``text_col`` replaced by the lines that stay, and n_lines, n_dropped as columns __n_lines, __n_dropped (with an underscore more if taken)."""
    doc, t, words = (free_name(docs, name) for name in ("__doc", "__t", "__words"))
    marks = bitmaps.select(F.col("doc").alias(doc), F.col("t").alias(t), F.col("words").alias(words))
    joined = docs.join(marks, docs[id_col].eqNullSafe(marks[doc]) & (F.xxhash64(text_of(text_col)) == marks[t]), "left")
    lines = F.split(text_of(text_col), "\n")
    n_lines = F.size(lines)
    gone = dropped_positions(F.col(words))
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    n_gone = F.aggregate(words, F.lit(0), lambda a, w: a + (WORD - F.bit_count(w["keep"])))
    return joined.select(
        *[c for c in docs.columns if c != text_col],
        F.when(F.col(words).isNull(), F.col(text_col)).otherwise(kept).alias(text_col),
        n_lines.cast("bigint").alias(free_name(docs, "__n_lines")),
        F.coalesce(n_gone, F.lit(0)).cast("bigint").alias(free_name(docs, "__n_dropped")),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Drop the lines whose key at least ``min_docs`` documents hold.

    Null and empty texts are one empty line, which never goes (its key has no code points).  A
    null id is a document of its own kind: rows with equal ids count as one document, and each
    loses its own lines only.  An empty table gives an empty result.  Other columns are kept; __n_lines and __n_dropped are added.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first), id_col, text_col)
