"""RDF sources and sinks: N-Triples and the one-triple-per-line part of Turtle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IRI, _BLANK = r"<([^>]*)>", r"(_:\S+)"
_LITERAL = r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?'
TRIPLE = rf"^\s*(?:{_IRI}|{_BLANK})\s+<([^>]*)>\s+(?:{_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"
COLUMNS = ["subject_kind", "subject", "predicate", "object_kind", "object_value", "object_language", "object_datatype"]


def _text(c: Column) -> Column:
    for short, raw in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r'\\"', '"')):
        c = F.regexp_replace(c, rf"(?<!\\){short}", raw)
    return F.regexp_replace(c, r"\\\\", r"\\")


def parse_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """The triples of N-Triples lines; blank lines and comments are left out. Lines that are no triple come out with all
    nulls but ``column``, see bad_lines()."""
    c = F.col(column)
    g = lambda i: F.regexp_extract(c, TRIPLE, i)
    rows = lines.where(~c.rlike(r"^\s*(#.*)?$")).withColumn("ok", c.rlike(TRIPLE))
    maybe = lambda v: F.when(F.col("ok") & (v != ""), v)
    s_iri = maybe(g(1))
    o_iri, o_blank = maybe(g(4)), maybe(g(5))
    kind = lambda iri, blank, other: F.when(iri.isNotNull(), "iri").when(blank.isNotNull(), "blank").otherwise(other)
    return rows.select(
        column,
        F.when(F.col("ok"), kind(s_iri, maybe(g(2)), F.lit(None).cast("string"))).alias("subject_kind"),
        F.coalesce(s_iri, maybe(g(2))).alias("subject"),
        maybe(g(3)).alias("predicate"),
        F.when(F.col("ok"), kind(o_iri, o_blank, F.lit("literal"))).alias("object_kind"),
        F.when(F.col("ok"), F.coalesce(o_iri, o_blank, _text(g(6)))).alias("object_value"),
        maybe(g(7)).alias("object_language"),
        maybe(g(8)).alias("object_datatype"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of N-Triples files, read and parsed by line in parallel; lines that are no triple are left out."""
    return parse_triples(spark.read.text(path)).where("subject_kind is not null").drop("value")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of the files that are neither triples nor comments."""
    return parse_triples(spark.read.text(path)).where("subject_kind is null").select("value")


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): each triple as an N-Triples line."""
    esc = F.col("object_value")
    for raw, short in ((r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        esc = F.regexp_replace(esc, raw, short)
    node = lambda k, v: F.when(F.col(k) == "blank", F.col(v)).otherwise(F.concat(F.lit("<"), F.col(v), F.lit(">")))
    tag = F.when(F.col("object_language").isNotNull(), F.concat(F.lit("@"), "object_language")).when(
        F.col("object_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("object_datatype"), F.lit(">"))
    ).otherwise("")
    obj = F.when(F.col("object_kind") == "literal", F.concat(F.lit('"'), esc, F.lit('"'), tag)).otherwise(node("object_kind", "object_value"))
    return triples.select(F.concat(node("subject_kind", "subject"), F.lit(" <"), "predicate", F.lit("> "), obj, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Triples as N-Triples files, sorted by line across the parts."""
    ntriples(triples).orderBy("value").write.mode("overwrite").text(path)


def read_turtle_facts(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object): the one-line statements of Turtle with prefixed names or IRIs, as written.

    Prefix declarations, comments and statements over several lines are left out.
    """
    pattern = r'^\s*(\S+)\s+(\S+)\s+("(?:[^"\\]|\\.)*"\S*|\S+)\s*\.\s*$'
    c = F.col("value")
    rows = spark.read.text(path).where(~c.rlike(r"^\s*(#|@|$)") & c.rlike(pattern))
    return rows.select(*[F.regexp_extract(c, pattern, i).alias(n) for i, n in ((1, "subject"), (2, "predicate"), (3, "object"))])
