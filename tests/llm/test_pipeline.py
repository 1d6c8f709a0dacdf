"""The pipeline's rows against plain Python over a small corpus."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from terrastat.llm.mixing import mix_sources
from terrastat.llm.queries import tokenizer_file
from terrastat.llm.toxicity import held_out, train_toxicity, with_toxicity

from .test_operators import brute_components, brute_hits


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 900, n)]
    item = " ".join(words(20))
    rows, labels = [], []
    for i in range(400):
        w = words(60)
        if i % 10 == 0:
            w[3] = w[8] = "vile"
        if i % 23 == 5:
            w[10:30] = item.split()
        text = " ".join(w)
        if i % 17 == 3:
            text = rows[-1][1] + " more"
        rows.append((i, None if i == 50 else text, "en", ["A", "B", None][i % 3], len(text)))
        labels.append((i, 0, int("vile" in text)))
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out()))
    score = {r.doc_id: r.score for r in with_toxicity(docs, model).collect()}
    assert sum(score[i] >= 0.5 for i, _, t in labels if t) > 30

    left = [(r[0], r[1]) for r in rows if score[r[0]] < 0.5]
    left = [(i, t) for (i, t), (_, n, c) in zip(left, brute_components(left, 5), strict=True) if n == 0 or i == c]
    left = [(i, t) for i, t in left if brute_hits(t, [(1, item)])[1] == 0]
    assert 100 < len(left) < 360
    source = {r[0]: r[3] for r in rows}
    mixed = mix_sources(spark.createDataFrame([(i, t, source[i]) for i, t in left], "doc_id long, text string, source string"))
    times = {r.doc_id: r.repeats for r in mixed.collect()}
    tok, want, at = Tokenizer.from_file(tokenizer_file()), [], 0
    for i, t in sorted(left):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for _ in range(times[i]):
            want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            at += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in C.run(spark, sf).collect())
    assert got == want


def test_stages_judge_rows_by_id_and_text(spark, tmp_path):
    """Rows that share an id, or lack one, are judged by their own texts; extra columns with clashing names are left out."""
    sf = str(tmp_path)
    item = " ".join(f"b{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    clean, near = " ".join(f"c{i}" for i in range(50)), " ".join(f"c{i}" for i in range(49)) + " end"
    rows = [(3, clean), (3, item + " tail"), (4, near), (4, "short and other text here"), (None, item), (None, "fine words all of them"), (5, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, word string, n_hit int, text_hash int")
    stage = dict(C.STAGES)
    assert stage["toxicity"](spark, docs, sf).count() == len(rows)
    left = stage["near_dedup"](spark, docs, sf)
    assert left.columns == C.COLUMNS and left.count() == len(rows) - 2 and left.where(F.col("text") == near).count() == 0
    clear = stage["decontamination"](spark, docs, sf)
    assert sorted((r.doc_id or 0, r.text or "") for r in clear.collect()) == sorted((i or 0, t or "") for i, t in rows if not (t or "").startswith("b0"))
    mixed = stage["mixing"](spark, docs, sf)
    assert mixed.columns == C.COLUMNS and sum(r.repeats for r in mix_sources(docs).collect()) == mixed.count()
    alike = spark.createDataFrame([(1, "a b c d e", "en", "A" if i < 40 else "B", 9) for i in range(80)], docs.select(*C.COLUMNS).schema)
    assert stage["mixing"](spark, alike, sf).count() == sum(r.repeats for r in mix_sources(alike).collect()) == 80
    assert stage["tokens"](spark, docs, sf).count() == len(rows)


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert C.run(spark, sf).count() == 0
