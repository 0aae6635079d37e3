"""Queries on facets of the documents, parts and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as fa
from ..runtime import table as t
from .registry import query

BOUNDS = [0, 200, 500, 1000, 5000]


def document_facets(spark, d):
    docs = t(spark, d, "documents")
    return fa.assignments(
        docs,
        "doc_id",
        {
            "lang": fa.plain("lang"),
            "source": fa.plain("source"),
            "doc_kind": fa.plain("doc_kind"),
            "collection": fa.plain("collection_id"),
            "length": fa.bucket("n_chars", BOUNDS),
            "month": fa.datetrunc("created_at", "month"),
            "long": fa.boolean(F.col("n_chars") > 1000),
        },
    )


ASSIGNED = """asg AS (
  SELECT doc_id, 'lang' AS facet_name, lang AS facet_value FROM documents WHERE lang IS NOT NULL
  UNION SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL
  UNION SELECT doc_id, 'doc_kind', doc_kind FROM documents WHERE doc_kind IS NOT NULL
  UNION SELECT doc_id, 'collection', collection_id FROM documents WHERE collection_id IS NOT NULL
  UNION SELECT doc_id, 'length', CASE WHEN n_chars >= 5000 THEN '4' WHEN n_chars >= 1000 THEN '3' WHEN n_chars >= 500 THEN '2'
                                      WHEN n_chars >= 200 THEN '1' ELSE '0' END FROM documents WHERE n_chars >= 0
  UNION SELECT doc_id, 'month', strftime(date_trunc('month', created_at), '%Y-%m-%d') FROM documents WHERE created_at IS NOT NULL
  UNION SELECT doc_id, 'long', CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END FROM documents WHERE n_chars IS NOT NULL
)"""
_FILTER = """hit AS (
  SELECT doc_id FROM asg WHERE (facet_name = 'lang' AND facet_value IN ('en', 'fr')) OR (facet_name = 'doc_kind' AND facet_value IN ('rule', 'minutes'))
  GROUP BY doc_id HAVING count(DISTINCT facet_name) = 2
)"""
_WANTED = {"lang": ["en", "fr"], "doc_kind": ["rule", "minutes"]}


@query(f"WITH {ASSIGNED} SELECT * FROM asg")
def facet_assignments(spark, d):
    """All facet kinds of the documents: plain, bucket, date and boolean."""
    return document_facets(spark, d)


@query(f"WITH {ASSIGNED}, {_FILTER} SELECT doc_id FROM hit")
def facet_filter(spark, d):
    """OR within a facet, AND across facets."""
    return fa.filter_documents(document_facets(spark, d), _WANTED)


@query(f"""WITH {ASSIGNED} SELECT doc_id FROM asg WHERE (facet_name = 'lang' AND facet_value = 'nl') OR (facet_name = 'length' AND facet_value = '3')
GROUP BY doc_id HAVING count(DISTINCT facet_name) = 2""")
def facet_filter_json(spark, d):
    """The same from a JSON object of single values."""
    return fa.filter_documents_json(document_facets(spark, d), '{"lang": "nl", "length": 3}')


@query(f"WITH {ASSIGNED} SELECT facet_name, facet_value, count(DISTINCT doc_id) AS doc_count FROM asg GROUP BY ALL")
def facet_value_counts(spark, d):
    return fa.facet_counts(document_facets(spark, d))


@query(f"""WITH {ASSIGNED}, {_FILTER} SELECT facet_name, facet_value, count(DISTINCT doc_id) AS doc_count
FROM asg WHERE facet_name = 'source' AND doc_id IN (SELECT doc_id FROM hit) GROUP BY ALL""")
def facet_counts_filtered(spark, d):
    """Counts of one facet under a filter."""
    a = document_facets(spark, d)
    return fa.facet_counts(a, "source", fa.filter_documents(a, _WANTED))


@query(f"""WITH {ASSIGNED}, cnt AS (SELECT facet_name, facet_value, count(DISTINCT doc_id) AS doc_count FROM asg GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY facet_name ORDER BY doc_count DESC, facet_value) AS rank FROM cnt QUALIFY rank <= 5""")
def facet_top_values(spark, d):
    """The five commonest values of every facet."""
    return fa.top_values(document_facets(spark, d), 5)


@query(f"""WITH {ASSIGNED} SELECT facet_name, count(DISTINCT facet_value) AS n_values, count(DISTINCT doc_id) AS n_documents,
count(*) AS n_postings FROM asg GROUP BY facet_name""")
def facet_describe(spark, d):
    return fa.describe(document_facets(spark, d))


_PARTS = """prt AS (
  SELECT p_partkey AS doc_id, 'brand' AS facet_name, p_brand AS facet_value FROM part
  UNION ALL SELECT p_partkey, 'type', p_type FROM part
), parents AS (
  SELECT DISTINCT 'type' AS facet_name, p_type AS facet_value, split_part(p_type, ' ', 1) AS parent_value FROM part
)"""


def _part_facets(spark, d):
    part = t(spark, d, "part")
    assigned = fa.assignments(part, "p_partkey", {"brand": fa.plain("p_brand"), "type": fa.plain("p_type")})
    parents = part.select(
        F.lit("type").alias("facet_name"), F.col("p_type").alias("facet_value"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("parent_value")
    ).distinct()
    return assigned, parents


@query(f"""WITH {_PARTS} SELECT facet_name, parent_value, facet_value, count(DISTINCT doc_id) AS doc_count
FROM prt JOIN parents USING (facet_name, facet_value) GROUP BY ALL""")
def facet_hierarchy(spark, d):
    """Counts of part types below their first word."""
    assigned, parents = _part_facets(spark, d)
    return fa.hierarchical_counts(assigned, parents)


@query(f"""WITH {_PARTS} SELECT DISTINCT facet_value FROM parents
WHERE parent_value = (SELECT min(parent_value) FROM parents)""")
def facet_children(spark, d):
    """Direct children of the first part family."""
    _, parents = _part_facets(spark, d)
    root = parents.agg(F.min("parent_value")).first()[0]
    return fa.children_of(parents, "type", root)


_TERMS = """valid AS (SELECT * FROM agent_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1),
terms AS (SELECT DISTINCT doc_id, trim(u) AS v FROM (SELECT doc_id, unnest(string_split(content, ';')) AS u FROM valid) WHERE trim(u) <> '')"""


def valid_facts(spark, d):
    """The rows of agent_facts with the highest version of each id."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc("version"), F.desc("updated_at"), "doc_id")
    return t(spark, d, "agent_facts").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


@query(f"WITH {_TERMS} SELECT 'term' AS facet_name, v AS facet_value, count(*) AS doc_count FROM terms GROUP BY v")
def facet_array_counts(spark, d):
    """An array facet: the terms of each fact."""
    facts = valid_facts(spark, d).select("doc_id", "content")
    words = F.filter(F.transform(F.split("content", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return fa.facet_counts(fa.assignments(facts, "doc_id", {"term": fa.array(words)}))


@query("""SELECT 'rating' AS facet_name, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS facet_value, count(DISTINCT event_id) AS doc_count
FROM events WHERE value IS NOT NULL GROUP BY 2""")
def facet_rating_counts(spark, d):
    """A rating facet: whole values of the events."""
    return fa.facet_counts(fa.assignments(t(spark, d, "events"), "event_id", {"rating": fa.rating("value")}))


_DELTAS = f"""{ASSIGNED}, log AS (
  SELECT doc_id, 'lang' AS facet_name, 'und' AS facet_value, 1 AS delta, 1 AS seq FROM documents WHERE lang IS NULL
  UNION ALL SELECT doc_id, 'doc_kind', doc_kind, -1, 2 FROM documents WHERE text IS NULL AND doc_kind IS NOT NULL
), merged AS (
  SELECT doc_id, facet_name, facet_value FROM asg WHERE (doc_id, facet_name, facet_value) NOT IN (SELECT doc_id, facet_name, facet_value FROM log WHERE delta = -1)
  UNION SELECT doc_id, facet_name, facet_value FROM log WHERE delta = 1
)"""


@query(f"WITH {_DELTAS} SELECT facet_name, facet_value, count(*) AS doc_count FROM merged GROUP BY ALL")
def facet_deltas(spark, d):
    """Counts after a log of changes: unlabelled documents get the language 'und', documents without text lose their kind."""
    docs = t(spark, d, "documents")
    one = lambda n, v, x, s: [F.lit(n).alias("facet_name"), v.alias("facet_value"), F.lit(x).alias("delta"), F.lit(s).alias("seq")]
    log = docs.where("lang is null").select("doc_id", *one("lang", F.lit("und"), 1, 1)).unionByName(
        docs.where("text is null and doc_kind is not null").select("doc_id", *one("doc_kind", F.col("doc_kind"), -1, 2))
    )
    return fa.facet_counts(fa.apply_deltas(document_facets(spark, d), log))


@query(f"WITH {ASSIGNED} SELECT facet_name, facet_value, count(*) AS cardinality FROM asg GROUP BY ALL")
def facet_bitmaps(spark, d):
    """Cardinalities of the postings as bitmaps."""
    made = fa.bitmaps(document_facets(spark, d))
    return made.groupBy("facet_name", "facet_value").agg(F.sum("cardinality").alias("cardinality"))


@query(f"""WITH {ASSIGNED}, hit AS (SELECT doc_id, 'doc.' || facet_name AS facet_name, facet_value FROM asg WHERE facet_name IN ('source', 'lang') AND contains(lower(facet_value), 'e'))
SELECT doc_id, min({{'a': facet_name, 'b': facet_value}}).a AS facet_name, min({{'a': facet_name, 'b': facet_value}}).b AS facet_value FROM hit GROUP BY doc_id""")
def facet_search_values(spark, d):
    """The documents with a source or language that has an E in it, each by its least value."""
    named = document_facets(spark, d).where("facet_name in ('source', 'lang')").withColumn("facet_name", F.concat(F.lit("doc."), "facet_name"))
    return fa.search_values(named, namespace="doc", value="E", limit=None)
