"""URL filtering by rules and a character language-model ratio [native].

Two variable-order Markov models over the characters of a URL, one of accepted and one of rejected
URLs, are estimated from the URLs that the rules decide.  Counts of every order are interpolated
down to the uniform distribution (Witten-Bell: the weight of an order is n / (n + distinct
followers)).  A URL's score is the log-likelihood difference divided by its length; the threshold is
calibrated on the training URLs to the best balanced accuracy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, materialise

#: (host, path, decision)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ALPHABET = 256  # size of the uniform distribution below order 0
URLS_PER_TASK = 5_000
STEP, REACH = 1000, 20  # score bins: a thousandth each, from -REACH to REACH


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, decision) of the longest rule that fits; nulls where none does.  Equal lengths: the later rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, decision in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _grams(df: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row per character of ``__text``: the character with the ``order`` characters before it (gram).  Texts are cut
    first, since the k-th character of a string is found by counting: long ones would take quadratic time."""
    pieces = F.regexp_extract_all("__text", F.lit("(?s).{1,256}"), 0)
    before = lambda i: F.coalesce(F.right(F.get("__pieces", i - 1), F.lit(order)), F.lit("\x02" * order))
    cut = df.where(F.length("__text") > 0).withColumn("__pieces", pieces)
    cut = cut.select(*keep, F.explode(F.transform("__pieces", lambda c, i: F.concat(before(i), c))).alias("__piece"))
    return cut.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("__piece") - order), lambda i: F.col("__piece").substr(i, F.lit(order + 1)))).alias("gram"))


def ratio_table(train: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """``gram, delta``: log p_accept - log p_reject of a gram's last character after its others.

    ``wanted`` lists the distinct grams to be scored.  Each order's counts come from the next longer
    gram's, so the corpus is exploded once; tables are of distinct grams only.
    """
    full = train.groupBy("label", "gram").agg(F.count(F.lit(1)).alias("n"))
    out = wanted
    probs = {"allow": F.lit(1.0 / ALPHABET), "block": F.lit(1.0 / ALPHABET)}
    for k in range(order + 1):
        seen = full.groupBy("label", F.substring("gram", order + 1 - k, k + 1).alias("g")).agg(F.sum("n").alias("n"))
        ctx = seen.groupBy("label", F.substring("g", 1, k).alias("c")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        cs = ctx.groupBy("c").pivot("label", ["allow", "block"]).agg(F.first("total").alias("total"), F.first("kinds").alias("kinds"))
        gs = seen.groupBy("g").pivot("label", ["allow", "block"]).agg(F.first("n"))
        gs = gs.select("g", F.col("allow").alias(f"n_allow{k}"), F.col("block").alias(f"n_block{k}"))
        cs = cs.select("c", *[F.col(f"{x}_{y}").alias(f"{y}_{x}{k}") for x in ("allow", "block") for y in ("total", "kinds")])
        out = out.join(gs, F.substring("gram", order + 1 - k, k + 1) == F.col("g"), "left").drop("g")
        out = out.join(cs, F.substring("gram", order + 1 - k, k) == F.col("c"), "left").drop("c")
        for x in probs:
            n, total, kinds = F.coalesce(F.col(f"n_{x}{k}"), F.lit(0)), F.col(f"total_{x}{k}"), F.col(f"kinds_{x}{k}")
            probs[x] = F.when(total.isNull(), probs[x]).otherwise((n + kinds * probs[x]) / (total + kinds))
    return out.select("gram", (F.log(probs["allow"]) - F.log(probs["block"])).alias("delta"))


def judge_urls(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    order: int = 3,
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, score, threshold, verdict``.

    ``score`` is the length-normalised log-likelihood difference (0 for an empty or null url),
    rounded to six decimals; where no rule fits, the verdict is allow if score >= threshold.  If no
    URL is accepted or none rejected by the rules there is no ratio: scores and threshold are 0 and
    all such URLs are allowed.

    Rows that repeat keep their own rows; null ids stay null.  Models hold grams of ``order`` + 1
    characters, so they grow with the alphabet, not with the table.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_of(url), path_of(url)
    rule, decision = matching_rule(F.col("host"), F.col("path"), rules)
    rows = df.select(F.col(id_col).alias("page_id"), url.alias("__text"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("label", decision)
    # URLs that repeat are scored once; each of their characters becomes a row, so they are dealt out to tasks first
    urls = rows.groupBy("__text").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("m")).withColumn("__key", F.monotonically_increasing_id())
    urls = materialise(urls, "urls")
    dealt = urls.repartition(min(urls.count() // URLS_PER_TASK + 1, 10_000), "__key")
    labelled = dealt.where(F.col("label").isNotNull())
    grams = _grams(labelled, order, "label")
    n_kinds = urls.where(F.col("label").isNotNull()).select("label").distinct().count()
    spots = _grams(dealt, order, "__key")
    if n_kinds == 2:
        delta = materialise(ratio_table(grams, spots.select("gram").distinct(), order), "url-grams")
        sums = spots.groupBy("__key", "gram").agg(F.count(F.lit(1)).alias("k")).join(delta, "gram").groupBy("__key").agg(F.sum(F.col("k") * F.col("delta")).alias("s"))
    else:
        sums = urls.select("__key", F.lit(0.0).alias("s"))
    scored = urls.join(sums, "__key", "left").select(
        "__text", "label", "m", F.coalesce(F.round(F.col("s") / F.greatest(F.length("__text"), F.lit(1)), 6), F.lit(0.0)).alias("score")
    )
    scored = materialise(scored, "url-scores")
    threshold = F.lit(float(calibrated(scored).first()[0]))
    return (
        rows.join(scored.select("__text", "score"), "__text", "left")
        .select(
            "page_id", "host", "path", "rule", "score", threshold.alias("threshold"),
            F.coalesce("label", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        )
    )


def calibrated(scored: DataFrame) -> DataFrame:
    """One row, ``threshold``: the bin edge of best balanced accuracy over labelled URLs; ties: nearest to 0."""
    edge = F.greatest(F.least(F.floor(F.col("score") * STEP), F.lit(REACH * STEP)), F.lit(-REACH * STEP))
    hist = scored.where(F.col("label").isNotNull()).groupBy(edge.alias("bin")).agg(
        F.sum(F.when(F.col("label") == "allow", F.col("m")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == "block", F.col("m")).otherwise(0)).alias("b"),
    )
    up, every = Window.orderBy(F.col("bin").desc()), Window.partitionBy(F.lit(1))
    hist = hist.select("bin", F.sum("a").over(up).alias("ta"), F.sum("b").over(up).alias("tb"), F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb"))
    gain = F.col("ta") / F.nullif("na", F.lit(0)) - F.col("tb") / F.nullif("nb", F.lit(0))
    best = hist.agg(F.max(F.struct(gain.alias("gain"), (-F.abs("bin")).alias("near"), "bin")).alias("m"))
    return best.select(F.when(F.col("m.gain").isNull(), 0.0).otherwise(F.col("m.bin") / STEP).alias("threshold"))
