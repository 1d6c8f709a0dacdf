"""Corpus pipeline over `documents`: the stages in order, each a function of (spark, docs, sf_dir).

Every stage works on all rows that the one before kept and returns the columns of documents; the
last returns a row per document with its place in the token files.  Run() cuts the lineage after
each stage with a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastat.llm.decontam import decontaminate
from terrastat.llm.minhash import near_duplicates
from terrastat.llm.mixing import mix_sources
from terrastat.llm.queries import tokenizer_file
from terrastat.llm.shared import materialise, table, without
from terrastat.llm.token_output import token_output
from terrastat.llm.toxicity import held_out, toxic_rows, train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: no SQL: the first stage's scores come from a trained model
ORACLE_SQL = None


def toxicity(spark, docs, sf_dir):
    """Documents with a toxicity score of 0.5 or more go.

    Scores are learnt from the labels outside the held-out fold, those with a null label or id left out.
    Null and empty texts score the model's bias.  A model that learnt from no document rejects none.
    Rows that repeat a text share its score.  Columns other than those of documents are left out; no
    documents give no rows.
    """
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    if not len(model[0]) and not model[2]:  # every score would be 0.5
        return docs.select(*COLUMNS)
    return without(docs.select(*COLUMNS), toxic_rows(docs, model))


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate component stays, the one with the least id.

    Five-word shingles, similarity 0.8.  Null and empty texts are linked with nothing and stay.  Rows
    that repeat the id and the text that stay stay all; one that shares the id alone is judged by its own
    text.  Components of null ids only stay whole.  Columns other than those of documents are left
    out; no documents give no rows.
    """
    return without(docs.select(*COLUMNS), near_duplicates(docs).where("not kept"))


def decontamination(spark, docs, sf_dir):
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts have no words and stay, items without words hit nothing.  Rows that share an
    id are judged by their own texts.  Columns other than those of documents are left out; without
    benchmark all stay, no documents give no rows.
    """
    return without(docs.select(*COLUMNS), decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def mixing(spark, docs, sf_dir):
    """Each document is repeated as often as the mix takes it.

    Rows that repeat id, text and source are alike: together they come as often as the mix takes them
    all.  Documents without words follow their hash, null sources are one source.  Columns other
    than those of documents are left out; no documents give no rows.
    """
    key = ["doc_id", "text_hash", "source"]
    taken = mix_sources(docs).groupBy(*key).agg(F.sum("repeats").alias("__n"), F.count(F.lit(1)).alias("__rows")).where("__n > 0")
    taken = materialise(taken.select(*[F.col(c).alias(f"__{c}") for c in key], "__n", "__rows"), "mix-taken")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__text_hash")) & F.col("source").eqNullSafe(F.col("__source"))
    met = docs.select(*COLUMNS).join(taken, same)

    def times(rows, n):
        return rows.where(n > 0).select(*COLUMNS, F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("__copy")).drop("__copy")

    out = times(met, F.floor(F.col("__n") / F.col("__rows")))
    if taken.where("__n % __rows > 0").limit(1).count():  # the mix takes only some of the rows that are alike
        out = out.unionByName(times(met.where("__n % __rows > 0").dropDuplicates(["__doc_id", "__text_hash", "__source"]), F.col("__n") % F.col("__rows")))
    return out


def tokens(spark, docs, sf_dir):
    """The token files' documents: ``doc_id, start, n_tokens, ids_crc32``.

    Null and empty texts are the end id alone; null ids come first, rows that repeat an id side by
    side, each with its own start.  Other columns are ignored; no documents write no file.
    """
    return token_output(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
