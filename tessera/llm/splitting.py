"""Splitting of oversized texts at natural boundaries, and the audit of given pieces (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import by_size

# A token is a longest run of ASCII letters, ASCII digits and bytes of non-ASCII characters.
_IS_TOKEN = np.array([i >= 0x80 or chr(i).isalnum() for i in range(256)])
_NEWLINE, _STOP, _BLANK = (np.array([i in s for i in range(256)]) for s in (b"\n", b".!?", b" \t\r\n"))


class Boundaries:
    """The token boundaries of a batch of texts, laid behind one another with a blank between.

    starts and ends are byte positions of all tokens; first[d] is the number of the first token of text d (with one
    entry more for the end), base[d] its first byte.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.length = np.array([len(r) for r in raw], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1].astype(np.int64)
        self.buffer = b" ".join(raw) + b" "
        self.bytes = np.frombuffer(self.buffer, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _IS_TOKEN[self.bytes]]).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, np.append(self.base, len(self.bytes)))

    def natural(self) -> np.ndarray:
        """Whether a text may well be cut before each token: after a paragraph, a line or a sentence."""
        gap_end = np.append(self.starts, len(self.bytes))
        gap_start = np.append(0, self.ends)
        lines = np.concatenate([[0], np.cumsum(_NEWLINE[self.bytes])])
        follows = np.append(_BLANK[self.bytes[1:]], True)
        stops = np.concatenate([[0], np.cumsum(_STOP[self.bytes] & follows)])
        return (lines[gap_end] > lines[gap_start]) | (stops[gap_end] > stops[gap_start])

    def farthest(self, limit: int) -> np.ndarray:
        """For each token the farthest boundary (as the number of the token behind it) a piece that begins there may have."""
        end_of_text = np.repeat(self.first[1:], np.diff(self.first))
        return np.minimum(np.arange(len(self.starts)) + limit, end_of_text)


def doubled(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All positions that are reached from ``roots`` by ``successor`` (ends point to themselves), sorted.

    By pointer doubling: after t rounds the table jumps 2^t steps, and all positions within 2^t - 1 steps are known.
    """
    reached = np.unique(roots)
    while True:
        more = np.union1d(reached, successor[reached])
        if len(more) == len(reached):
            return reached
        reached, successor = more, successor[successor]


def cut(bounds: Boundaries, limit: int, overlap: int, least: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """(first token, token behind the last) of all pieces of all texts of the batch, in order.

    Each piece ends at the farthest natural boundary that leaves it ``least`` of the limit (and some tokens beyond the
    overlap), else at the farthest token boundary; the next begins ``overlap`` tokens before that.
    """
    n = len(bounds.starts)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    token = np.arange(n)
    end_of_text = np.repeat(bounds.first[1:], np.diff(bounds.first))
    far = bounds.farthest(limit)
    good = np.maximum.accumulate(np.where(bounds.natural(), np.arange(n + 1), -1))
    end = np.where(good[far] > token + max(overlap, int(limit * least)), good[far], far)
    end = np.where(far == end_of_text, end_of_text, end)
    successor = np.where(end == end_of_text, token, end - overlap)
    starts = doubled(successor, bounds.first[:-1][np.diff(bounds.first) > 0])
    return starts, end[starts]


def _positive(limit: int, overlap: int) -> None:
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be at least 1, the overlap at least 0 and below the limit")


def valid_documents(raw: DataFrame, *more: str) -> DataFrame:
    """(doc_id, content, *more): of the rows of each doc_id the one with the latest updated_at (then loaded_at).

    Rows with null doc_id are left out; a null updated_at is oldest. Repeated rows count once.
    """
    latest = Window.partitionBy("doc_id").orderBy(F.desc("updated_at"), F.desc("loaded_at"), F.desc("content"))
    return (
        raw.where(F.col("doc_id").isNotNull())
        .select("doc_id", "updated_at", "loaded_at", "content", *more)
        .withColumn("rank", F.row_number().over(latest))
        .where("rank = 1")
        .select("doc_id", "content", *more)
    )


def valid_pieces(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, s, e, content): each piece once, the latest loaded_at counts; e from the content where null.

    Rows with null doc_id, chunk_index or offset_start can't be placed and are left out.
    """
    key = [F.col(c) for c in ("doc_id", "chunk_index", "offset_start")]
    rows = chunks.where(key[0].isNotNull() & key[1].isNotNull() & key[2].isNotNull()).select(
        "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "loaded_at",
        F.col("offset_start").cast("long").alias("s"),
        F.coalesce("offset_end", F.col("offset_start") + F.coalesce(F.octet_length("content"), F.lit(0)))
        .cast("long")
        .alias("e"),
        "content",
    )
    last = Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("loaded_at"), "s", "e", "content")
    return rows.withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank", "loaded_at")


def split_oversized(texts: DataFrame, limit: int = 256, overlap: int = 32) -> DataFrame:
    """Pieces of at most ``limit`` tokens for every text of ``texts`` that has more; other columns are kept.

    ``texts`` has content and any other columns but chunk_index, offset_start, offset_end, token_count. Pieces come
    with chunk_index from 0, byte offsets in the text's UTF-8 form (end exclusive), token_count and their content, which
    replaces the text's. Consecutive pieces share exactly ``overlap`` tokens; each begins and ends between tokens, at
    the end of a paragraph, line or sentence where one is in reach. The first begins and the last ends with the
    text. Texts that are null, empty or within the limit give no pieces. One pass without a shuffle.
    """
    _positive(limit, overlap)
    keep = [f for f in texts.schema.fields if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    names = [f.name for f in keep]
    out = "chunk_index long, offset_start long, offset_end long, token_count long, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "content", 4 << 20):
            bounds = Boundaries(b.column("content").to_pylist())
            first, behind = cut(bounds, limit, overlap)
            doc = np.searchsorted(bounds.first, first, "right") - 1
            big = np.diff(bounds.first)[doc] > limit
            first, behind, doc = first[big], behind[big], doc[big]
            if not len(doc):
                continue
            begins = np.append(True, doc[1:] != doc[:-1])
            ends = np.append(begins[1:], True)
            index = np.arange(len(doc)) - np.maximum.accumulate(np.where(begins, np.arange(len(doc)), 0))
            s = np.where(begins, bounds.base[doc], bounds.starts[first])
            e = np.where(ends, bounds.base[doc] + bounds.length[doc], bounds.ends[behind - 1])
            rows = pa.array(doc)
            cols = [b.column(n).take(rows) for n in names] + [
                pa.array(index, pa.int64()),
                pa.array(s - bounds.base[doc], pa.int64()),
                pa.array(e - bounds.base[doc], pa.int64()),
                pa.array(behind - first, pa.int64()),
                pa.array([bounds.buffer[i:j].decode() for i, j in zip(s.tolist(), e.tolist())], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "chunk_index", "offset_start", "offset_end", "token_count", "content"])

    # A text of n tokens has at least 2n - 1 bytes.
    long_enough = texts.where(F.octet_length("content") > 2 * limit).select(*names, "content")
    return long_enough.mapInArrow(run, f"{schema}, {out}" if schema else out)


def pieces_of_corpus(raw: DataFrame, chunks: DataFrame, limit: int = 256, overlap: int = 32) -> DataFrame:
    """Pieces of every valid document and of every given piece that hold more than ``limit`` tokens.

    Columns: doc_id, parent_chunk_index (null for a document), chunk_index, offset_start, offset_end (in the document),
    token_count, content. See split_oversized(), valid_documents() and valid_pieces().
    """
    docs = valid_documents(raw).select(
        "doc_id", F.lit(None).cast("long").alias("parent_chunk_index"), F.lit(0).cast("long").alias("at"), "content"
    )
    given = valid_pieces(chunks).select(
        "doc_id", F.col("chunk_index").alias("parent_chunk_index"), F.col("s").alias("at"), "content"
    )
    out = split_oversized(docs.unionByName(given), limit, overlap)
    return out.select(
        "doc_id",
        "parent_chunk_index",
        "chunk_index",
        (F.col("at") + F.col("offset_start")).alias("offset_start"),
        (F.col("at") + F.col("offset_end")).alias("offset_end"),
        "token_count",
        "content",
    )


def audit(bounds: Boundaries, doc: np.ndarray, index: np.ndarray, s: np.ndarray, e: np.ndarray, limit: int, overlap: int):
    """(doc, index) of faulty pieces, and of texts over the limit with a token in no piece (index -1).

    ``doc`` numbers the text of each piece, ``s`` and ``e`` are its bytes in that text. A piece is sound if it begins and
    ends at boundaries, its end is no farther than the farthest legal boundary from its begin, and the piece before
    it ends ``overlap`` tokens behind its begin. Coverage is found like cuts are: every boundary points to the farthest
    end of a piece that reaches over it, the table is doubled, and a text is whole if its begin leads to its end.
    """
    n = len(bounds.starts)
    length = bounds.length[doc]
    s, e = (bounds.base[doc] + np.clip(x, 0, length) for x in (s, e))
    a, b = np.searchsorted(bounds.starts, s, "left"), np.searchsorted(bounds.ends, e, "right")
    inside = (np.searchsorted(bounds.ends, s, "right") < a) | (np.searchsorted(bounds.starts, e, "left") > b)
    b = np.maximum(a, b)
    far = np.append(bounds.farthest(limit), n)
    bad = inside | ((b > a) & (b > far[a]))
    order = np.lexsort((index, doc))
    follows = np.zeros(len(doc), dtype=bool)
    shared = np.full(len(doc), -1)
    if len(order) > 1:
        p, q = order[:-1], order[1:]
        follows[q] = (doc[p] == doc[q]) & (index[p] + 1 == index[q])
        shared[q] = np.minimum(b[p], b[q]) - np.maximum(a[p], a[q])
    bad |= (index > 0) & ~(follows & (shared == overlap))
    reach = np.zeros(n + 1, dtype=np.int64)
    np.maximum.at(reach, a, b)
    reach = np.maximum(np.maximum.accumulate(reach), np.arange(n + 1))
    while True:
        twice = reach[reach]
        if (twice == reach).all():
            break
        reach = twice
    size = np.diff(bounds.first)
    lost = np.flatnonzero((size > limit) & (reach[bounds.first[:-1]] < bounds.first[1:]))
    return np.concatenate([doc[bad], lost]), np.concatenate([index[bad], np.full(len(lost), -1)])


def faulty_pieces(raw: DataFrame, chunks: DataFrame, limit: int = 256, overlap: int = 32) -> DataFrame:
    """(doc_id, chunk_index): the pieces in ``chunks`` that don't split the documents in ``raw`` as required.

    A piece is faulty if it holds more than ``limit`` tokens, begins or ends inside a token of its document, or has
    chunk_index above 0 and doesn't share exactly ``overlap`` whole tokens with the piece of the preceding index (also
    where that one is missing). chunk_index -1 stands for a document of more than ``limit`` tokens of which a token
    lies whole in no piece. Offsets beyond the document end with it. Rows are cleaned by valid_documents() and
    valid_pieces(); pieces of documents that don't exist have nothing to be held against and are left out. Empty tables
    give no rows. Each document meets its pieces in one join, in which only positions come from the pieces.
    """
    _positive(limit, overlap)
    given = valid_pieces(chunks).groupBy("doc_id").agg(F.collect_list(F.struct("chunk_index", "s", "e")).alias("pieces"))
    docs = valid_documents(raw).join(given, "doc_id", "left")
    docs = docs.where(F.col("pieces").isNotNull() | (F.octet_length("content") > 2 * limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "content", 4 << 20):
            bounds = Boundaries(batch.column("content").to_pylist())
            lists = batch.column("pieces")
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            index, s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            doc, index = audit(bounds, doc, index, s, e, limit, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(index.astype(np.int64))], names=["doc_id", "chunk_index"]
            )

    return docs.select("doc_id", "content", "pieces").mapInArrow(run, "doc_id long, chunk_index long")
