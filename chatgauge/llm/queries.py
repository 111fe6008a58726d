"""Registered queries of the corpus operators: thin projections of what the operators return."""

from pyspark.sql import functions as F

from . import (
    apportion, backoff, boosted, factor, grammar, gru, middle, multi_index, packing, simhash_bk, sketch, sql,
    templates, weak_rules,
)

QUERIES, ORACLES = {}, {}


def query(oracle=None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op3_weak_rules(spark, sf_dir):
    judged = weak_rules.weak_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 6).alias("posterior"), *weak_rules.VOTES,
    )


@query(sql.MIX)
def op7_sainte_lague(spark, sf_dir):
    mixed = apportion.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query()
def op1_length_buckets(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op4_simhash_bktree(spark, sf_dir):
    found = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_bk.hex_of(F.col("fp")).alias("fingerprint"), "component_id", "component_size")


@query()
def op10_boosted_trees(spark, sf_dir):
    return boosted.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_factor_machine(spark, sf_dir):
    return factor.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_byte_gru(spark, sf_dir):
    return gru.languages(table(spark, sf_dir, "documents"))


@query()
def op6_scaled_sketch(spark, sf_dir):
    return sketch.fingerprint_neighbours(table(spark, sf_dir, "documents"))


@query()
def op9_path_templates(spark, sf_dir):
    judged = templates.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("share", 6).alias("share"))


@query(sql.BACKOFF)
def op2_stupid_backoff(spark, sf_dir):
    scored = backoff.scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("per_word", 6).alias("per_word"))


@query(sql.MIDDLE)
def op11_wavelet_middle(spark, sf_dir):
    cut = middle.fill_in_middle_digests(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query(sql.HARD_NEGATIVES)
def op13_multi_index(spark, sf_dir):
    mined = multi_index.hard_negatives(table(spark, sf_dir, "embeddings"))
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query()
def op12_format_grammar(spark, sf_dir):
    found = grammar.secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in grammar.KINDS]
    base = grammar.joined(f"filter(spans, s -> s.kind <> '{grammar.ADDED}')")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), grammar.joined("spans").alias("spans"))
