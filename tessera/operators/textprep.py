"""Preparation of texts: HTML to text, references, French/Dutch split, prompt budgets, type names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_small, running_sum
from .search import ascii_lower

BLOCK_TAGS = "p|br|div|li|h[1-6]|tr"
# The words that vote for French and Dutch.
FRENCH = "le la les des du de et article arrete loi royal federal commune service est sont pour dans".split()
DUTCH = "de het een en artikel besluit wet koninklijk federaal gemeente dienst is zijn voor van in".split()


def strip_html(html: Column) -> Column:
    """The text of markup: tags of blocks become line ends, other tags blanks, white space is collapsed. Entities stay."""
    lines = F.regexp_replace(html, rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "\u0001")
    flat = F.regexp_replace(F.regexp_replace(lines, r"<[^>]*>?", " "), r"[ \t\r\n\f\u000B]+", " ")
    return F.regexp_replace(F.regexp_replace(flat, r" ?(?:\u0001 ?)+", "\n"), r"^\n", "")


_URL = r"https?://[^\s)\]]*"
_CODE, _BODY = r"[0-9A-Za-z./_-]", r"(?:(?! and )[0-9A-Za-z ./_-])"
_REF = rf"[ \t]*{_CODE}*(?: of {_BODY}*)?"


def extract_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, reference): the distinct references of each text.

    'url' for http addresses, 'internal' for "article ...", 'external' for decree, law, ordinance or regulation with
    what follows: a code and maybe "of ...". Words of another word's middle don't count; any case; null texts have none.
    """
    c = F.col(text)
    word = lambda names: F.regexp_extract_all(c, F.lit(rf"(?i)(?<![0-9A-Za-z_])((?:{names})(?![0-9A-Za-z_]){_REF})"), F.lit(1))
    kinds = {"url": F.regexp_extract_all(c, F.lit(f"({_URL})"), F.lit(1)), "internal": word("article"), "external": word("decree|law|ordinance|regulation")}

    def listed(kind: str, found: Column) -> Column:
        return F.transform(F.transform(found, lambda x: F.rtrim(x)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("reference")))

    rows = F.array_distinct(F.concat(*[listed(k, v) for k, v in kinds.items()]))
    out = texts.select(key, F.explode(rows).alias("r")).select(key, "r.kind", "r.reference")
    bare = F.lower("reference").isin("article", "decree", "law", "ordinance", "regulation")
    return out.where(~bare)


def _votes(line: Column, words: list[str]) -> Column:
    found = F.split(ascii_lower(line), r"[ \t\r\n.,;:!?()\[\]{}\"']+")
    return F.size(F.filter(found, lambda w: w.isin(*words)))


def split_french_dutch(texts: DataFrame, key: str, text: str, least: int = 32) -> DataFrame:
    """(key, language, text): the lines of each language by the words that vote for it, both 'fr' and 'nl' only where
    each has at least ``least`` visible characters, else the whole text as 'und'. Lines without a winner go with the
    language that has less text so far."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("t"), (_votes(x, FRENCH) - _votes(x, DUTCH)).alias("v")))
    start = F.struct(F.lit("").alias("fr"), F.lit("").alias("nl"))

    def put(acc: Column, line: Column) -> Column:
        to_fr = (line["v"] > 0) | ((line["v"] == 0) & (F.octet_length(acc["fr"]) <= F.octet_length(acc["nl"])))
        add = F.concat(line["t"], F.lit("\n"))
        return F.struct(F.when(to_fr, F.concat(acc["fr"], add)).otherwise(acc["fr"]).alias("fr"), F.when(to_fr, acc["nl"]).otherwise(F.concat(acc["nl"], add)).alias("nl"))

    split = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), F.aggregate(lines, start, put).alias("s"))
    seen = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    both = (seen("s.fr") >= least) & (seen("s.nl") >= least)
    part = lambda lang, c: F.struct(F.lit(lang).alias("language"), c.alias("text"))
    rows = F.when(both, F.array(part("fr", F.col("s.fr")), part("nl", F.col("s.nl")))).otherwise(F.array(part("und", F.col("t"))))
    return split.select(key, F.explode(rows).alias("r")).select(key, "r.language", "r.text")


def prompt_limits(docs: DataFrame, group: str, key: str, length: str, budget: int) -> DataFrame:
    """(group, key, length, char_limit, truncated): how much of each document of a group fits its budget of characters.

    All of it if the group fits; else each gets its share in proportion, and what rounding leaves goes one by one to
    the first documents by key that are still short. Negative or null lengths count 0; keys are unique within a group. Sums
    are pre-aggregated and turns counted range by range, so no task holds a whole group.
    """
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(group, key, n.alias("length"))

    def with_sum(df: DataFrame, value: str, name: str) -> DataFrame:
        sums = broadcast_small(df.groupBy(group).agg(F.sum(value).alias(name)))
        return df.alias("a").join(sums.alias("b"), F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}"))).select("a.*", f"b.{name}")

    rows = with_sum(rows, "length", "_all")
    share = F.when(F.col("_all") <= budget, F.col("length")).otherwise(F.floor(F.col("length") * budget / F.col("_all")))
    rows = with_sum(rows.withColumn("_share", share.cast("long")), "_share", "_given")
    rows = running_sum(rows, [group], [key], (F.col("_share") < F.col("length")).cast("long"), "_turn")
    limit = F.col("_share") + F.when((F.col("_share") < F.col("length")) & (F.col("_turn") <= budget - F.col("_given")), 1).otherwise(0)
    return rows.select(group, key, "length", limit.alias("char_limit"), (F.col("_share") < F.col("length")).alias("truncated"))


def budget_batches(docs: DataFrame, group: str, key: str, length: str, budget: int) -> DataFrame:
    """(group, key, batch): documents by key in batches that fit the budget; a larger one is a batch of its own.

    Greedy batching is sequential within a group: the rows stream through in order, and only the current sum is held, so
    a large group costs time in one task but no memory. Null groups are left out.
    """
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("length")
    rows = docs.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used, batch = None, 0, -1
        for pdf in batches:
            out = []
            for g, size in zip(pdf["g"], pdf["length"]):
                if g != last:
                    last, used, batch = g, size, 0
                elif used + size <= budget:
                    used += size
                else:
                    used, batch = size, batch + 1
                out.append(batch)
            yield pd.DataFrame({"g": pdf["g"], "k": pdf["k"], "batch": out})

    kind = rows.schema["k"].dataType.simpleString()
    streamed = rows.repartition("g").sortWithinPartitions("g", "k").mapInPandas(run, f"g string, k {kind}, batch int")
    return streamed.withColumnsRenamed({"g": group, "k": key})


def map_names(c: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of an alias, or the name itself."""
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), aliases.items(), F.when(c.isNull(), None)).otherwise(c)
