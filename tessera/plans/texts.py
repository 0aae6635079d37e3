"""Queries on the preparation of texts: chunks, references, markup, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as ch
from ..operators import search as se
from ..operators import textprep as tp
from ..runtime import table as t
from .registry import query

_TOKENS = r"len(regexp_extract_all(text, '(?:[0-9A-Za-z]|[^\x00-\x7F])+'))"


def _chunks(spark, d, strategy, **options):
    return ch.chunk(t(spark, d, "documents"), "doc_id", "text", strategy, **options)


@query(f"""WITH n AS (SELECT doc_id, {_TOKENS} AS n FROM documents WHERE text IS NOT NULL), w AS (
  SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil((n - 32) / 224.0) AS BIGINT)))) AS chunk_index FROM n WHERE n > 0)
SELECT doc_id, chunk_index, least(256, n - chunk_index * 224) AS token_count FROM w""")
def chunk_fixed_token(spark, d):
    return _chunks(spark, d, "fixed_token").select("doc_id", "chunk_index", "token_count")


@query(r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(c, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM p WHERE trim(c, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""")
def chunk_paragraph(spark, d):
    return _chunks(spark, d, "paragraph").select("doc_id", "content")


# Of each text: a hash of the characters in its chunks that aren't white space, in order, and the number of chunks that aren't the slice
# of the text that their offsets name, begin before the last one's end, or are over the limit though a blank could part them.
_VISIBLE = r"regexp_replace({x}, '[ \t\n\r\f\v]+', '', 'g')"
_COVER = f"SELECT doc_id, md5({_VISIBLE.format(x='text')}) AS visible, 0 AS faults FROM documents WHERE {_VISIBLE.format(x='text')} <> ''"


def _cover(spark, d, strategy, limit=None, **options):
    rows = _chunks(spark, d, strategy, **options).join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    piece = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("offset_start").cast("int") + 1, (F.col("offset_end") - F.col("offset_start")).cast("int")), "UTF-8")
    over = (F.octet_length("content") > limit) & F.contains("content", F.lit(" ")) if limit else F.lit(False)
    fault = ((piece != F.col("content")) | over).cast("int").alias("f")
    of = rows.select("doc_id", F.struct("chunk_index", "offset_start", "offset_end", "content", fault).alias("c"))
    listed = of.groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("l"))
    behind = F.zip_with(F.slice("l", F.lit(2), F.size("l")), F.slice("l", F.lit(1), F.size("l") - 1), lambda x, y: (x["offset_start"] < y["offset_end"]).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    text = F.regexp_replace(F.concat_ws("", F.transform("l", lambda x: x["content"])), r"[ \t\n\r\f\x0B]+", "")
    return listed.select("doc_id", F.md5(text.cast("binary")).alias("visible"), (total(F.transform("l", lambda x: x["f"])) + total(behind)).alias("faults"))


@query(_COVER)
def chunk_sentence(spark, d):
    """Packed sentences hold all of each text, in order."""
    return _cover(spark, d, "sentence")


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])([ \t\r\n])', '\1' || chr(1) || '\2', 'g'), '\n\n', chr(10) || chr(1) || chr(10), 'g'),
  '\n\n', chr(10) || chr(1) || chr(10), 'g'), chr(1))) AS c FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, trim(c, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM s)
SELECT doc_id, content FROM v WHERE content <> ''""")
def chunk_single_sentences(spark, d):
    """Sentences by themselves, as none fits with another into no room."""
    return _chunks(spark, d, "sentence", max_chars=0).select("doc_id", "content")


@query(_COVER)
def chunk_recursive(spark, d):
    """Parts by ever finer separators hold all of each text, in order, and none is over the limit that a blank could part."""
    return _cover(spark, d, "recursive_character", 512, max_chars=512)


@query(_COVER)
def chunk_structure(spark, d):
    return _cover(spark, d, "structure_aware", 2048)


@query(rf"""WITH part AS (SELECT doc_id, text, regexp_extract(text, '(?im)^[ \t\r]*(?:article\b|art\.|section\b)(?s:.*)', 0) AS tail FROM documents),
c AS (SELECT doc_id, {_VISIBLE.format(x="CASE WHEN tail = '' THEN text ELSE tail END")} AS v FROM part) SELECT doc_id, md5(v) AS visible, 0 AS faults FROM c WHERE v <> ''""")
def chunk_legal(spark, d):
    """Articles hold all of each text from its first heading on."""
    return _cover(spark, d, "legal")


@query(f"""WITH n AS (SELECT doc_id, {_TOKENS} AS n FROM documents WHERE text <> ''), w AS (
  SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil((n - 32) / 224.0) AS BIGINT)))) AS i FROM n WHERE n > 0)
SELECT doc_id, CAST(0 AS BIGINT) AS chunk_index, n AS token_count, NULL AS parent_chunk_index FROM n UNION ALL SELECT doc_id, i + 1, least(256, n - i * 224), 0 FROM w""")
def chunk_late(spark, d):
    """The whole text and, below it, its windows of tokens."""
    return _chunks(spark, d, "late").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "token_count", "parent_chunk_index")


@query(r"""WITH raw AS (SELECT DISTINCT doc_id, content FROM documents_raw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, loaded_at DESC, content DESC) = 1)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?i)</?(?:p|br|div|li|h[1-6]|tr)(?:\s[^>]*)?/?>', chr(1), 'g'),
  '<[^>]*>?', ' ', 'g'), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ?(?:\x01 ?)+', chr(10), 'g'), '^\n', '') AS plain FROM raw WHERE content LIKE '<%'""")
def text_strip_html(spark, d):
    """The text of the documents that are markup."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.desc("updated_at"), F.desc("loaded_at"), F.desc("content"))
    raw = t(spark, d, "documents_raw").withColumn("_r", F.row_number().over(w)).where("_r = 1 and content like '<%'")
    return raw.select("doc_id", tp.strip_html(F.col("content")).alias("plain"))


@query(r"""SELECT DISTINCT doc_id, 'url' AS kind, unnest(regexp_extract_all(text, 'https?://[^\s)\]]*')) AS reference FROM documents""")
def text_urls(spark, d):
    return tp.extract_references(t(spark, d, "documents"), "doc_id", "text").where("kind = 'url'")


_CODE = r"[0-9A-Za-z./_-]"


@query(rf"""WITH m AS (SELECT doc_id, regexp_replace(text, ' and ', ' ' || chr(1) || 'and ', 'g') AS x FROM documents WHERE text IS NOT NULL),
f AS (SELECT DISTINCT doc_id, 'url' AS kind, unnest(regexp_extract_all(text, 'https?://[^\s)\]]*')) AS r FROM documents
  UNION SELECT doc_id, 'internal', unnest(regexp_extract_all(x, '(?i:\barticle\b)[ \t]*\x01?{_CODE}*(?: (?i:of) [0-9A-Za-z ./_-]*)?')) FROM m
  UNION SELECT doc_id, 'external', unnest(regexp_extract_all(x, '(?i:\b(?:decree|law|ordinance|regulation)\b)[ \t]*\x01?{_CODE}*(?: (?i:of) [0-9A-Za-z ./_-]*)?')) FROM m),
c AS (SELECT DISTINCT doc_id, kind, rtrim(replace(r, chr(1), ''), ' ') AS reference FROM f)
SELECT doc_id, kind, reference FROM c WHERE lower(reference) NOT IN ('article', 'decree', 'law', 'ordinance', 'regulation')""")
def text_references(spark, d):
    """URLs, articles and legal instruments that the documents name."""
    return tp.extract_references(t(spark, d, "documents"), "doc_id", "text")


_VOTE = "len(list_filter(ws, lambda x: x IN ({words})))"
_FR, _NL = (_VOTE.format(words=", ".join(f"'{w}'" for w in words)) for words in (tp.FRENCH, tp.DUTCH))
_SIDE = "v > 0 OR (v = 0 AND fo <= no)"


@query(rf"""WITH RECURSIVE ln AS (SELECT doc_id, i, l[i + 1] AS t FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, i, t, regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n.,;:!?()\[\]{{}}"'']+') AS ws FROM ln),
v AS (SELECT doc_id, i, {_FR} - {_NL} AS v, octet_length(encode(t)) + 1 AS o, length(t) + 1 AS c, length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS s FROM w),
r AS (SELECT doc_id, CAST(-1 AS BIGINT) AS i, 0::BIGINT AS fo, 0::BIGINT AS no, 0::BIGINT AS fc, 0::BIGINT AS nc, 0::BIGINT AS fs, 0::BIGINT AS ns FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT v.doc_id, v.i, fo + CASE WHEN {_SIDE} THEN o ELSE 0 END, no + CASE WHEN {_SIDE} THEN 0 ELSE o END, fc + CASE WHEN {_SIDE} THEN c ELSE 0 END,
    nc + CASE WHEN {_SIDE} THEN 0 ELSE c END, fs + CASE WHEN {_SIDE} THEN s ELSE 0 END, ns + CASE WHEN {_SIDE} THEN 0 ELSE s END FROM r JOIN v ON v.doc_id = r.doc_id AND v.i = r.i + 1),
last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)
SELECT doc_id, 'fr' AS language, fc AS n_chars FROM last WHERE fs >= 32 AND ns >= 32 UNION ALL SELECT doc_id, 'nl', nc FROM last WHERE fs >= 32 AND ns >= 32
UNION ALL SELECT doc_id, 'und', length(text) FROM documents JOIN last USING (doc_id) WHERE NOT (fs >= 32 AND ns >= 32)""")
def text_french_dutch(spark, d):
    """The lines of each language, by the words that vote for it, of the texts that have both."""
    return tp.split_french_dutch(t(spark, d, "documents"), "doc_id", "text").withColumn("n_chars", F.length("text")).drop("text")


_N = "greatest(coalesce(n_chars, 0), 0)"


@query(f"""WITH r AS (SELECT source, doc_id, {_N} AS length, sum({_N}) OVER (PARTITION BY source) AS total FROM documents),
s AS (SELECT *, CASE WHEN total <= 20000 THEN length ELSE CAST(floor(CAST(length AS DOUBLE) * 20000 / total) AS BIGINT) END AS share FROM r),
u AS (SELECT *, 20000 - sum(share) OVER (PARTITION BY source) AS spare, sum(CAST(share < length AS INT)) OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM s)
SELECT source, doc_id, length, share + CASE WHEN share < length AND turn <= spare THEN 1 ELSE 0 END AS char_limit, share < length AS truncated FROM u""")
def text_prompt_limits(spark, d):
    """Shares of a budget of 20,000 characters per source."""
    return tp.prompt_limits(t(spark, d, "documents"), "source", "doc_id", "n_chars", 20_000)


@query(f"""WITH RECURSIVE r AS (SELECT source, doc_id, {_N} AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE source IS NOT NULL),
w AS (SELECT source, doc_id, i, n AS used, 0 AS batch FROM r WHERE i = 1
  UNION ALL SELECT r.source, r.doc_id, r.i, CASE WHEN used + n <= 20000 THEN used + n ELSE n END, CASE WHEN used + n <= 20000 THEN batch ELSE batch + 1 END FROM w JOIN r ON r.source = w.source AND r.i = w.i + 1)
SELECT source, doc_id, batch FROM w""")
def text_budget_batches(spark, d):
    """Batches of at most 20,000 characters of each source's documents."""
    return tp.budget_batches(t(spark, d, "documents"), "source", "doc_id", "n_chars", 20_000)


@query("""WITH c AS (SELECT doc_id, source_ref FROM documents_raw WHERE source_ref IS NOT NULL)
SELECT lower(split_part(string_split(source_ref, '/')[-1], '.', -1)) AS extension, count(*) AS n FROM c GROUP BY 1""")
def text_source_extensions(spark, d):
    """Source facets: how many rows each file extension has."""
    rows = t(spark, d, "documents_raw").where("source_ref is not null").select("doc_id", "source_ref", F.lit(0).alias("chunk_index"), F.lit("none").alias("strategy"))
    facets = ch.source_facets(rows, "doc_id", "source_ref").where("facet_name = 'extension'")
    return facets.groupBy(F.col("facet_value").alias("extension")).agg(F.count("*").alias("n"))


_SENTENCES = r"""s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])([ \t\r\n])', '\1' || chr(1) || '\2', 'g'), '\n\n', chr(10) || chr(1) || chr(10), 'g'),
  '\n\n', chr(10) || chr(1) || chr(10), 'g'), chr(1)), lambda c: trim(c, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda c: c <> '') AS l FROM documents WHERE text IS NOT NULL),
sent AS (SELECT doc_id, i, l[i + 1] AS content, length(l[i + 1]) % 3 < 2 AS kind FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM s))"""


@query(f"""WITH RECURSIVE {_SENTENCES}, w AS (SELECT doc_id, i, kind, 1 AS n, 0 AS run FROM sent WHERE i = 0
  UNION ALL SELECT t.doc_id, t.i, t.kind, CASE WHEN t.kind = w.kind AND n < 4 THEN n + 1 ELSE 1 END, CASE WHEN t.kind = w.kind AND n < 4 THEN run ELSE run + 1 END FROM w JOIN sent t ON t.doc_id = w.doc_id AND t.i = w.i + 1)
SELECT doc_id, run AS chunk_index, CAST(sum({_TOKENS.replace("(text,", "(content,")}) AS BIGINT) AS token_count FROM w JOIN sent USING (doc_id, i) GROUP BY ALL""")
def chunk_semantic(spark, d):
    """Runs of up to four sentences whose vectors are alike; the vectors here follow from the sentences' lengths."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    axis = F.when(F.length("content") % 3 < 2, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(2.0)))
    vectors = ch.sentence_table(docs, "doc_id", "text").select("doc_id", F.col("chunk_index").alias("sentence_index"), axis.alias("values"))
    return ch.semantic_chunks(docs, "doc_id", "text", vectors, 0.5, 2**31 - 1, 4).select("doc_id", "chunk_index", "token_count")


@query(f"""WITH n AS (SELECT doc_id, {_TOKENS} AS n FROM documents WHERE text <> ''), tok AS (SELECT doc_id, n, unnest(range(n)) AS i FROM n),
win AS (SELECT doc_id, 0 AS chunk_index, i FROM tok UNION ALL
  SELECT doc_id, w + 1, i FROM (SELECT doc_id, n, i, unnest(range(greatest(1, CAST(ceil((n - 32) / 224.0) AS BIGINT)))) AS w FROM tok) WHERE i >= w * 224 AND i < w * 224 + 256)
SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, round(avg(i % 5), 6) AS a, round(avg(i), 6) AS b FROM win GROUP BY ALL""")
def chunk_late_vectors(spark, d):
    """The windows' vectors from those of their tokens, which here follow from the tokens' places."""
    docs = t(spark, d, "documents").where("text != ''").select("doc_id", F.posexplode(se.tokens(F.col("text"))).alias("token_index", "t"))
    vectors = docs.select("doc_id", "token_index", F.array((F.col("token_index") % 5).cast("double"), F.col("token_index").cast("double")).alias("values"))
    out = ch.late_vectors(vectors, "doc_id")
    return out.select("doc_id", "chunk_index", F.round(F.col("values")[0], 6).alias("a"), F.round(F.col("values")[1], 6).alias("b"))
