"""Season labels from standings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Label cut-offs by conference seed.
TOP6 = 6
TOP10 = 10
PLAYOFF_SEED = 8


def seeds(standings: DataFrame, method: str = "row_number",
          tiebreak: tuple[str, ...] = ("point_diff",)) -> DataFrame:
    """Conference seed per season.

    ``row_number`` gives strict seeds 1..n (ties broken by the tiebreak
    columns descending, then team_id); ``dense_rank`` orders by wins only and
    shares seeds on ties, which inflates the top-k labels.
    Partitions are (season, conference): at most a few dozen teams each.
    """
    conf = Window.partitionBy("season_start", "conference")
    if method == "row_number":
        order = [F.desc("wins")] + [F.desc(c) for c in tiebreak] + [F.asc("team_id")]
        seed = F.row_number().over(conf.orderBy(*order))
    elif method == "dense_rank":
        seed = F.dense_rank().over(conf.orderBy(F.desc("wins")))
    else:
        raise ValueError(f"unknown seeding method {method!r}")
    return standings.withColumn("conf_seed", seed.cast("bigint"))


def season_labels(seeded: DataFrame) -> DataFrame:
    """made_top6_conf, made_top10_conf, made_playoffs (seed <= 8) per team-season."""
    s = F.col("conf_seed")
    return seeded.select(
        "season_start", "team_id", "conference", "conf_seed",
        F.when(s <= TOP6, 1).otherwise(0).alias("made_top6_conf"),
        F.when(s <= TOP10, 1).otherwise(0).alias("made_top10_conf"),
        F.when(s <= PLAYOFF_SEED, 1).otherwise(0).alias("made_playoffs"))
