"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table as t
from . import abuse, language, packing, splitting, terms, tokens, vectors


def p1_found(spark, d):
    """Pairs with at least 4 occurrences of a term that 2 to 6 records hold; the score is a value only and drops none."""
    scored = terms.distinctive_terms(t(spark, d, "bm25_term_frequencies"))
    return scored.where("freq >= 4 and ndoc between 2 and 6").select("doc_id", "term_text")


def p1_terms(spark, d):
    """All pairs with their probability and score, to six decimals (moved off their halves, which engines round either way)."""
    scored = terms.distinctive_terms(t(spark, d, "bm25_term_frequencies"))
    return scored.withColumns({"log_p": F.round(F.col("log_p") + 3e-10, 6), "score": F.round("score", 6)})


def p3_found(spark, d):
    return vectors.similar_pairs(t(spark, d, "agent_facts"))


def p3_neighbours(spark, d):
    return vectors.similar_facts(t(spark, d, "agent_facts"))


def p3_recall(spark, d):
    """How much of what brute force finds for the facts whose doc_id is divisible by 100 the index finds as well."""
    return vectors.recall(t(spark, d, "agent_facts"))


def p4_found(spark, d):
    counted = terms.term_frequencies(t(spark, d, "bm25_term_frequencies"))
    return counted.where("mark is not null").select("term_text", "mark")


def p4_terms(spark, d):
    return terms.term_frequencies(t(spark, d, "bm25_term_frequencies"))


def p4_ngrams(spark, d):
    """Runs of up to three terms in the renderings of the valid facts, with their counts and marks."""
    return terms.content_ngrams(t(spark, d, "agent_facts"))


def p5_found(spark, d):
    return language.mislabelled(t(spark, d, "documents_raw"), t(spark, d, "label_aliases"))


def p5_segments(spark, d):
    return language.language_segments(t(spark, d, "documents_raw"), t(spark, d, "label_aliases"))


def p6_found(spark, d):
    return splitting.faulty_pieces(t(spark, d, "documents_raw"), t(spark, d, "chunks_raw"))


def p6_pieces(spark, d):
    return splitting.pieces_of_corpus(t(spark, d, "documents_raw"), t(spark, d, "chunks_raw"))


def p6_cover(spark, d):
    """For each oversized document: its tokens by its pieces, less what two share, its bytes from first to last, and pieces over the limit."""
    pieces = splitting.split_oversized(splitting.valid_documents(t(spark, d, "documents_raw")))
    return pieces.groupBy("doc_id").agg(
        (F.sum("token_count") - 32 * (F.count("*") - 1)).alias("tokens"),
        (F.max("offset_end") - F.min("offset_start")).alias("bytes"),
        F.count_if((F.col("token_count") > 256) | (F.octet_length("content") != F.col("offset_end") - F.col("offset_start"))).alias("faults"),
    )


def p8_ids(spark, d):
    return tokens.encode_documents(t(spark, d, "documents"))


def p9_containers(spark, d):
    return packing.fill_containers(t(spark, d, "documents"))


def p9_fill(spark, d):
    return packing.container_fill(packing.fill_containers(t(spark, d, "documents")))


def p9_invariants(spark, d):
    """Documents that come out, containers over the capacity, and documents split below it, of which there are none."""
    filled = packing.fill_containers(t(spark, d, "documents"))
    per_doc = filled.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("parts"))
    wrong = F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / 2048))
    docs = per_doc.agg(F.count("*").alias("documents"), F.count_if(wrong).alias("split_wrongly"))
    over = filled.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("overfull"))
    return docs.join(over)  # one row each


def p10_found(spark, d):
    return abuse.abusive_documents(t(spark, d, "documents"))


def p10_scores(spark, d):
    return abuse.score_documents(t(spark, d, "documents"))


def p10_sources(spark, d):
    return abuse.rates_by_source(t(spark, d, "documents"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "p" and n[1:2].isdigit()}
