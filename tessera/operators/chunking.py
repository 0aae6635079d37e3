"""Chunking of texts by eight strategies, as one Arrow pass per strategy (semantic: a join with the sentences' vectors).

All work on the text's UTF-8 bytes: offsets are byte positions, end exclusive. A token is a run of ASCII letters and
digits and bytes of other characters. Null and empty texts have no chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import spread
from .search import token_count

Span = tuple[int, int]
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
PARAGRAPH = re.compile(rb"\n[ \t\r]*\n")
SENTENCE = re.compile(rb"[.!?](?=[ \t\r\n])|[.!?]\Z|\n(?=\n)")
HEADING = re.compile(rb"^#{1,6}[ \t].*$", re.MULTILINE)
FENCE = re.compile(rb"^[ \t]*(?:```|~~~)[^\n]*(?:\n|\Z)", re.MULTILINE)
ARTICLE = re.compile(rb"^[ \t\r]*(?:article\b|art\.|section\b)", re.MULTILINE | re.IGNORECASE)
SEPARATORS = (b"\n\n", b"\n", b". ", b"? ", b"! ", b"; ", b", ", b" ")
# So many bytes of chunks make a batch, whatever the number of texts.
BATCH_BYTES = 4 << 20
STRATEGIES = ("fixed_token", "sentence", "paragraph", "recursive_character", "structure_aware", "late", "legal")


def count_tokens(text: bytes) -> int:
    return len(TOKEN.findall(text))


def _trim(text: bytes, s: int, e: int) -> list[Span]:
    part = text[s:e]
    s += len(part) - len(part.lstrip())
    e = s + len(part.strip())
    return [(s, e)] if e > s else []


def _cut(text: bytes, s: int, e: int, at: list[int]) -> list[Span]:
    """The trimmed spans between the given positions."""
    edges = [s, *[p for p in at if s < p < e], e]
    return [x for a, b in zip(edges, edges[1:]) for x in _trim(text, a, b)]


def fixed_token(text: bytes, target: int, overlap: int) -> list[Span]:
    """Windows of ``target`` tokens that share ``overlap`` tokens; the last ends with the text's last token."""
    if overlap >= target:
        raise ValueError("the overlap must be below the target")
    t = [m.span() for m in TOKEN.finditer(text)]
    last = max(0, len(t) - overlap - 1) // (target - overlap) if t else -1
    starts = [i * (target - overlap) for i in range(last + 1)]
    return [(t[i][0], t[min(i + target, len(t)) - 1][1]) for i in starts]


def paragraphs(text: bytes) -> list[Span]:
    """What blank lines part, trimmed."""
    return _cut(text, 0, len(text), [m.start() for m in PARAGRAPH.finditer(text)])


def sentences(text: bytes) -> list[Span]:
    """What ends with . ! ? and white space, or with a blank line, trimmed."""
    return _cut(text, 0, len(text), [m.end() for m in SENTENCE.finditer(text)])


def packed_sentences(text: bytes, max_chars: int) -> list[Span]:
    """Sentences, joined while the whole stays within ``max_chars`` bytes."""
    out: list[Span] = []
    for s, e in sentences(text):
        if out and e - out[-1][0] <= max_chars:
            out[-1] = out[-1][0], e
        else:
            out.append((s, e))
    return out


def recursive(text: bytes, max_chars: int) -> list[Span]:
    """Parts within ``max_chars``, split by ever finer separators, which stay with the part before them."""
    done: list[Span] = []
    todo = [(0, len(text), 0)]
    while todo:
        s, e, depth = todo.pop()
        if e - s <= max_chars or depth == len(SEPARATORS):
            done += _trim(text, s, e)
            continue
        sep = SEPARATORS[depth]
        ends = [s + m.end() for m in re.finditer(re.escape(sep), text[s:e])]
        edges = [s, *[x for x in ends if x < e], e]
        todo += [(a, b, depth + 1) for a, b in reversed(list(zip(edges, edges[1:])))]
    return done


def _bounded(text: bytes, spans: list[Span], max_chars: int, split: Callable[[bytes], list[Span]]) -> list[Span]:
    return [x for s, e in spans for x in ([(s, e)] if e - s <= max_chars else [(s + a, s + b) for a, b in split(text[s:e])])]


def structure(text: bytes, max_chars: int) -> list[Span]:
    """Sections below markdown headings and whole code fences; larger ones are split recursively."""
    fences, opened = [], None
    for m in FENCE.finditer(text):
        if opened is None:
            opened = m.start()
        else:
            fences.append((opened, m.end()))
            opened = None
    if opened is not None:
        fences.append((opened, len(text)))
    heads = [m.start() for m in HEADING.finditer(text) if not any(a <= m.start() < b for a, b in fences)]
    sections = _cut(text, 0, len(text), sorted({*heads, *[p for f in fences for p in f]}))
    return _bounded(text, sections, max_chars, lambda part: recursive(part, max_chars))


def legal(text: bytes, max_chars: int) -> list[Span]:
    """From one article or section heading to the next; larger ones by paragraph; without headings by structure."""
    heads = [m.start() for m in ARTICLE.finditer(text)]
    if not heads:
        return structure(text, max_chars)
    articles = _cut(text, heads[0], len(text), heads)
    return _bounded(text, articles, max_chars, paragraphs)


def semantic(text: bytes, embed: Callable[[list[str]], list[list[float]]], threshold: float, max_chars: int, max_sentences: int) -> list[Span]:
    """Runs of sentences, closed where neighbours' cosine falls below the threshold or the run is too long."""
    spans = sentences(text)
    vectors = embed([text[s:e].decode("utf-8", "replace") for s, e in spans]) if spans else []
    if len(vectors) != len(spans):
        raise ValueError("one vector per sentence is needed")
    out: list[Span] = []
    run = 0
    for i, (s, e) in enumerate(spans):
        near = out and _cosine(vectors[i - 1], vectors[i]) >= threshold and spans[i - 1][1] - out[-1][0] <= max_chars and run < max_sentences
        if near:
            out[-1], run = (out[-1][0], e), run + 1
        else:
            out.append((s, e))
            run = 1
    return out


def _cosine(a: list[float], b: list[float]) -> float:
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def spans_of(text: bytes, strategy: str, target: int, overlap: int, max_chars: int) -> list[tuple[int, int, int | None]]:
    """(start, end, parent) of the chunks of a text."""
    if strategy == "fixed_token":
        flat = fixed_token(text, target, overlap)
    elif strategy == "late":
        return [(0, len(text), None), *[(s, e, 0) for s, e in fixed_token(text, target, overlap)]]
    elif strategy == "paragraph":
        flat = paragraphs(text)
    elif strategy == "sentence":
        flat = packed_sentences(text, max_chars)
    elif strategy == "recursive_character":
        flat = recursive(text, max_chars)
    elif strategy == "structure_aware":
        flat = structure(text, max_chars)
    elif strategy == "legal":
        flat = legal(text, max_chars)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return [(s, e, None) for s, e in flat]


def chunk(
    texts: DataFrame, key: str, text: str, strategy: str = "recursive_character", target_tokens: int = 256, overlap_tokens: int = 32, max_chars: int = 2048
) -> DataFrame:
    """(key, chunk_index, offset_start, offset_end, token_count, parent_chunk_index, strategy, content) of every text.

    An overlap that isn't below the target, and an unknown strategy, raise ValueError; 'semantic' needs vectors, see semantic_chunks().
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if overlap_tokens >= target_tokens:
        raise ValueError("the overlap must be below the target")
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk_index", "offset_start", "offset_end", "token_count", "parent_chunk_index", "content"]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())

        def made(keys: pa.Array, take: list[int], rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 6
            arrays = [keys.take(pa.array(take, pa.int64()))] + [pa.array(c, ty) for c, ty in zip(cols, types)]
            return pa.RecordBatch.from_arrays(arrays, names=[key, *names])

        for b in batches:
            take, rows, size = [], [], 0
            for i, t in enumerate(b.column(1)):
                raw = (t.as_py() or "").encode()
                if not raw:
                    continue
                tokens = [m.start() for m in TOKEN.finditer(raw)]  # chunks begin and end between tokens
                for k, (s, e, parent) in enumerate(spans_of(raw, strategy, target_tokens, overlap_tokens, max_chars)):
                    take.append(i)
                    rows.append((k, s, e, bisect_left(tokens, e) - bisect_left(tokens, s), parent, raw[s:e].decode("utf-8", "replace")))
                    size += e - s
                if size > BATCH_BYTES:
                    yield made(b.column(0), take, rows)
                    take, rows, size = [], [], 0
            yield made(b.column(0), take, rows)

    schema = f"`{key}` {kind}, chunk_index int, offset_start long, offset_end long, token_count long, parent_chunk_index int, content string"
    return spread(texts.select(key, text)).mapInArrow(run, schema).withColumn("strategy", F.lit(strategy))


def semantic_chunks(
    texts: DataFrame, key: str, text: str, vectors: DataFrame, threshold: float = 0.5, max_chars: int = 2048, max_sentences: int = 16
) -> DataFrame:
    """chunk() by meaning: runs of sentences, closed where neighbours' cosine falls below the threshold or the run is too long.

    ``vectors`` (key, sentence_index, values) has a vector for each sentence that sentence_table() gives; a sentence without one, or with
    one of other length or all zero, is like no other. A run is at most ``max_sentences`` sentences and its sentences but the last
    within ``max_chars`` bytes. The sentences of a text meet their vectors in one join and stream by text.
    """
    rows = sentence_table(texts, key, text)
    rows = rows.join(vectors.select(key, F.col("sentence_index").alias("chunk_index"), F.col("values").cast("array<double>").alias("v")), [key, "chunk_index"], "left")
    last = Window.partitionBy(key).orderBy("chunk_index")
    before = F.lag("v").over(last)
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y * y))
    dot = F.aggregate(F.zip_with("v", before, lambda x, y: x * y), F.lit(0.0), lambda acc, y: acc + y)
    like = F.when((F.size("v") == F.size(before)) & (norm(F.col("v")) * norm(before) > 0), dot / (norm(F.col("v")) * norm(before)))
    rows = rows.withColumn("near", F.coalesce(like >= threshold, F.lit(False)))
    spans = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "offset_start", "offset_end", "near"))).alias("s"))
    state = F.struct(F.array().cast("array<struct<s:bigint,e:bigint,n:int>>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        run = F.try_element_at(acc["out"], F.lit(-1))
        joins = x["near"] & (run["e"] - run["s"] <= max_chars) & (run["n"] < max_sentences)
        kept = F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        longer = F.array(F.struct(run["s"].alias("s"), x["offset_end"].alias("e"), (run["n"] + 1).alias("n")))
        new = F.array(F.struct(x["offset_start"].alias("s"), x["offset_end"].alias("e"), F.lit(1).alias("n")))
        return F.struct(F.when(F.coalesce(joins, F.lit(False)), F.concat(kept, longer)).otherwise(F.concat(acc["out"], new)).alias("out"))

    runs = spans.select(key, F.posexplode(F.aggregate("s", state, put)["out"]).alias("chunk_index", "c"))
    whole = runs.join(texts.select(key, text), key)
    start, size = F.col("c.s").cast("int") + 1, (F.col("c.e") - F.col("c.s")).cast("int")
    piece = F.decode(F.substring(F.encode(text, "UTF-8"), start, size), "UTF-8")
    return whole.select(
        key, "chunk_index", F.col("c.s").alias("offset_start"), F.col("c.e").alias("offset_end"), token_count(piece).cast("long").alias("token_count"),
        F.lit(None).cast("int").alias("parent_chunk_index"), piece.alias("content"), F.lit("semantic").alias("strategy"),
    )


def sentence_table(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_index, offset_start, offset_end, content): each sentence by itself, to be given vectors."""
    return chunk(texts, key, text, "sentence", max_chars=0).select(key, "chunk_index", "offset_start", "offset_end", "content")


def late_vectors(vectors: DataFrame, key: str, target_tokens: int = 256, overlap_tokens: int = 32) -> DataFrame:
    """(key, chunk_index, values): late chunking's vectors from those of the text's tokens (key, token_index from 0, values).

    Each window of chunk(..., 'late') gets the mean of its tokens' vectors, and chunk 0, the whole text, the mean of all. A token lies in as
    many windows as overlap there; sums are pre-aggregated by dimension, so no task holds a whole text.
    """
    if overlap_tokens >= target_tokens:
        raise ValueError("the overlap must be below the target")
    step = target_tokens - overlap_tokens
    n = vectors.groupBy(key).agg((F.max("token_index") + 1).alias("_n"))
    rows = vectors.join(n, key)
    last = F.greatest(F.floor((F.greatest(F.col("_n") - overlap_tokens - 1, F.lit(0))) / step), F.lit(0))
    first = F.greatest(F.lit(0), F.ceil((F.col("token_index") - target_tokens + 1) / step))
    windows = F.filter(F.sequence(first.cast("int"), F.floor(F.col("token_index") / step).cast("int")), lambda i: i <= last)
    rows = rows.select(key, F.explode(F.concat(F.array(F.lit(0)), F.transform(windows, lambda i: (i + 1).cast("int")))).alias("chunk_index"), "values")
    dims = rows.select(key, "chunk_index", F.posexplode("values").alias("d", "x")).groupBy(key, "chunk_index", "d").agg(F.avg("x").alias("x"))
    return dims.groupBy(key, "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y["x"]).alias("values"))


def source_facets(chunks: DataFrame, key: str, path: str) -> DataFrame:
    """(key, chunk_index, facet_name, facet_value): path, filename, extension, directories, chunk index and count, strategy.

    ``path`` is the column of each row's source path; null paths give only the facets of the chunk itself.
    """
    p = F.col(path)
    name = F.substring_index(p, "/", -1)
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))
    dirs = F.filter(F.slice(F.split(p, "/"), F.lit(1), F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), lambda x: x != "")
    total = F.count("*").over(Window.partitionBy(key))
    one = lambda n, v: F.array(F.struct(F.lit(n).alias("n"), v.cast("string").alias("v")))
    rows = F.concat(
        one("path", p), one("filename", name), one("extension", ext),
        F.coalesce(F.transform(dirs, lambda x: F.struct(F.lit("directory").alias("n"), x.alias("v"))), F.array().cast("array<struct<n:string,v:string>>")),
        one("chunk_index", F.col("chunk_index")), one("chunk_count", F.col("_total")), one("strategy", F.col("strategy")),
    )
    out = chunks.withColumn("_total", total).select(key, "chunk_index", F.explode(rows).alias("f"))
    return out.select(key, "chunk_index", F.col("f.n").alias("facet_name"), F.col("f.v").alias("facet_value")).where("facet_value is not null")


# The strategy, target tokens, overlap and byte ceiling for each recommended splitter.
POLICY = {
    "technical_structure": ("structure_aware", 384, 32, 2048),
    "legal_article": ("legal", 512, 32, 4096),
    "legal_consolidated": ("legal", 512, 32, 4096),
    "legal_amendment": ("legal", 384, 32, 3072),
    "business_rule": ("paragraph", 320, 24, 2048),
    "fallback_recursive": ("recursive_character", 256, 32, 2048),
}


def decide(splitter: str, target_tokens: int = 0, max_chars: int = 0) -> dict:
    """The options of chunk() for a document profile; a given target replaces the policy's, a ceiling only raises it."""
    strategy, target, overlap, ceiling = POLICY[splitter]
    return {"strategy": strategy, "target_tokens": target_tokens or target, "overlap_tokens": overlap, "max_chars": max(max_chars, ceiling)}
