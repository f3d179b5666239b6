"""Operator 6 (native): URL filter by rules and by the likelihood ratio of two character models.

URLs that a rule accepts or rejects train two variable-order Markov models over their characters, smoothed by
Witten-Bell interpolation from the longest context down to no context. A URL is scored by the difference of its
log-likelihoods under the two, divided by its length; the least score to be allowed is calibrated on ruled URLs
held out from training. The models are tables of character grams: all of it is DataFrame joins and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rimshot.llm.registry import query, table
from rimshot.session import checkpoint_dir

#: (verdict, host, path start)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 3            # characters of context
BEGIN, END = "\u0002", "\u0003"
HELD_OUT = 4         # one in so many ruled URLs calibrates
BIN = 0.02           # resolution of the calibrated score
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, host).otherwise(""), F.when(at > 0, path).otherwise("")


def ruling(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits (the first of equals), or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def _grams(address: Column) -> Column:
    """Every character of an address with ORDER characters before it; the end is a character too."""
    padded = F.concat(F.lit(BEGIN * ORDER), address, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(address) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def gram_ratio(training: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio): log p_accepted - log p_rejected of the last character of each gram given those before it.

    ``training``: (gram, accepted, rejected) counts; ``wanted``: (gram), distinct. Each order's estimate is
    (count + kinds * estimate of the next lower order) / (total + kinds), with the number of different characters
    seen after a context as ``kinds``; the lowest order falls back to equal shares.
    """
    out = wanted
    for side in ("accepted", "rejected"):
        out = out.withColumn(f"p_{side}", F.lit(1.0 / 256))
    for k in range(1, ORDER + 2):
        own = (training.groupBy(F.substring("gram", ORDER + 2 - k, k).alias("own"))
               .agg(F.sum("accepted").alias("n_accepted"), F.sum("rejected").alias("n_rejected")))
        context = own.groupBy(F.substring("own", 1, k - 1).alias("context")).agg(
            F.sum("n_accepted").alias("all_accepted"), F.sum("n_rejected").alias("all_rejected"),
            F.count(F.when(F.col("n_accepted") > 0, 1)).alias("kinds_accepted"),
            F.count(F.when(F.col("n_rejected") > 0, 1)).alias("kinds_rejected"))
        out = (out.withColumn("own", F.substring("gram", ORDER + 2 - k, k)).withColumn("context", F.substring("own", 1, k - 1))
               .join(own, "own", "left").join(context, "context", "left"))
        for side in ("accepted", "rejected"):
            kinds = F.coalesce(F.col(f"kinds_{side}"), F.lit(0))
            estimate = ((F.coalesce(F.col(f"n_{side}"), F.lit(0)) + kinds * F.col(f"p_{side}"))
                        / (F.coalesce(F.col(f"all_{side}"), F.lit(0)) + kinds))
            out = out.withColumn(f"p_{side}", F.when(kinds > 0, estimate).otherwise(F.col(f"p_{side}")))
        out = out.select("gram", "p_accepted", "p_rejected")
    return out.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def calibrated_cut(scores: DataFrame) -> float | None:
    """The least bin that is allowed: the one with the best balanced accuracy, the lowest of equals.

    ``scores``: (score, accepted, rejected) with counts. The scores are mean log ratios, so their bins are a few
    hundred at most and stand in one window. None unless both kinds occur.
    """
    bins = (scores.groupBy(F.floor(F.col("score") / BIN).alias("bin"))
            .agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_bins = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = bins.select(
        "bin", F.sum("accepted").over(all_bins).alias("all_accepted"), F.sum("rejected").over(all_bins).alias("all_rejected"),
        F.coalesce(F.sum("accepted").over(below), F.lit(0)).alias("missed"),
        F.coalesce(F.sum("rejected").over(below), F.lit(0)).alias("caught")).filter("all_accepted > 0 and all_rejected > 0")
    balance = F.round((F.col("all_accepted") - F.col("missed")) / F.col("all_accepted") + F.col("caught") / F.col("all_rejected"), 12)
    best = judged.select("bin", balance.alias("balance")).orderBy(F.desc("balance"), "bin").limit(1).collect()
    return best[0]["bin"] * BIN if best else None


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict, else that of the models.

    Null URLs and those without ``://`` have an empty host and path, and are judged as empty addresses. Null ids
    and repeated rows stay. Unless rules both accept and reject some URL there is no model: the score is 0 and
    such URLs are allowed. URLs are counted once for each row; equal addresses are scored once.
    """
    checkpoint_dir(df.sparkSession)
    host, path = host_and_path(F.col("url"))
    pages = (df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
             .select("page_id", host.alias("host"), path.alias("path"))
             .withColumn("ruled", ruling(F.col("host"), F.col("path"), rules))
             .withColumn("address", F.concat("host", "path")))
    # one row an address: what the rules say of it and how many pages have it
    addresses = (pages.groupBy("address").agg(
        F.count(F.when(F.col("ruled.verdict") == "allow", 1)).alias("accepted"),
        F.count(F.when(F.col("ruled.verdict") == "block", 1)).alias("rejected"),
        F.count(F.when(F.col("ruled").isNull(), 1)).alias("open"))
        .withColumn("held", (F.col("accepted") + F.col("rejected") > 0) & (F.pmod(F.xxhash64("address"), F.lit(HELD_OUT)) == 0)))
    grams = (addresses.filter((F.col("open") > 0) | (F.col("accepted") + F.col("rejected") > 0))
             .select("address", "accepted", "rejected", "open", "held", F.explode(_grams(F.col("address"))).alias("gram")))
    counts = (grams.groupBy("gram").agg(
        F.sum(F.when(~F.col("held"), F.col("accepted")).otherwise(0)).alias("accepted"),
        F.sum(F.when(~F.col("held"), F.col("rejected")).otherwise(0)).alias("rejected"))).checkpoint()
    training = counts.filter((F.col("accepted") > 0) | (F.col("rejected") > 0))
    ratio = gram_ratio(training, counts.select("gram"))
    asked = grams.filter((F.col("open") > 0) | F.col("held"))
    scores = (asked.join(ratio, "gram").groupBy("address").agg(
        F.round(F.avg("ratio"), 9).alias("score"), F.max("accepted").alias("accepted"), F.max("rejected").alias("rejected"),
        F.max("open").alias("open"), F.max("held").alias("held"))).checkpoint()
    cut = calibrated_cut(scores.filter("held"))
    scored = pages.join(scores.filter("open > 0").select("address", "score"), "address", "left")
    score = F.col("score") if cut is not None else F.lit(0.0)
    method = F.when(score >= (cut or 0.0), "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), method).alias("verdict"),
        F.when(F.col("ruled").isNull(), score).alias("score"))


@query("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
