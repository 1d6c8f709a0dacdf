"""The registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .html_render import extract_text
from .lattice_lm import lattice_scores
from .line_dedup import kept_lines, line_bitmaps
from .minhash import near_duplicates
from .mixing import mix_sources
from .shared import materialise, table
from .spelling import spelling_variants, words_of
from .token_output import token_output
from .toxicity import held_out, train_toxicity, with_toxicity
from .turns import damaged, repair_conversations, repaired_digests
from .url_filter import judge_urls
from .warc import archive_pages


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = with_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_output(spark, sf_dir):
    return token_output(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_decontaminate(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_warc(spark, sf_dir):
    captures = archive_pages(table(spark, sf_dir, "pages"), with_payload=False)
    rec = F.col("response")
    key = lambda name: F.element_at(rec["headers"], name).try_cast("long")
    return captures.select(
        key("X-Capture-Key").alias("page_id"),
        rec["payload_bytes"].alias("payload_bytes"),
        rec["payload_digest"].alias("payload_digest"),
        rec["type"].alias("record_type"),
        key("X-Refers-To-Key").alias("refers_to"),
    )


def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4).drop("text_hash")


def op8_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_lattice_scores(spark, sf_dir):
    import public_tokenizers

    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark, sf_dir):
    """The contract's words: of every 31st run by hash one letter is missing; those of 7 letters that come twice count."""
    runs = words_of(table(spark, sf_dir, "documents").select("doc_id", "text"), at_least=7)
    word = F.col("word")
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (F.col("hash") % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    written = runs.select(word, hashed.alias("hash")).select(F.when(F.col("hash") % 31 == 0, cut).otherwise(word).alias("word"))
    words = written.where(F.char_length("word") >= 7).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return spelling_variants(words)


def op12_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = kept_lines(docs, line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(given)
    repairs = materialise(repair_conversations(rows), "repairs")
    digests = repaired_digests(rows, repairs).select(F.col("conv_id").alias("__digest_of"), "repaired_sha256")
    repairs = repairs.withColumnRenamed("conv_id", "__repair_of")
    met = given.select("conv_id").distinct().join(repairs, F.col("conv_id").eqNullSafe(F.col("__repair_of")), "left")
    met = met.join(digests, F.col("conv_id").eqNullSafe(F.col("__digest_of")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
