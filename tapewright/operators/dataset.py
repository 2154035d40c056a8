"""Model rows: features with bounds, complete cases, seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.numbers import clip, scaled_move

FEATURES = ["z30", "z60", "lrv", "lvs", "gapc", "tod_open", "tod_close"]


def model_features(rows: DataFrame) -> DataFrame:
    """Adds the seven model features. A missing gap or relative volume counts as 0; a missing move stays missing."""
    return rows.select(
        "*",
        scaled_move("cumres30", "rv60").alias("z30"), scaled_move("cumres60", "rv60").alias("z60"),
        F.ln(F.col("rv60") + 1e-8).alias("lrv"), F.coalesce(F.ln(clip("vsurp", 0.05, 20.0)), F.lit(0.0)).alias("lvs"),
        F.coalesce(clip("gap", -0.10, 0.10), F.lit(0.0)).alias("gapc"),
        (F.col("bkt") < 630).cast("double").alias("tod_open"), (F.col("bkt") >= 900).cast("double").alias("tod_close"),
    )


def complete_cases(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is null or not a number."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return rows.where(ok)


def by_label(rows: DataFrame, labels: list[str], features: list[str] = FEATURES) -> DataFrame:
    """Long form: (date, sym, bkt, label, y, features), complete cases of each label. One pass: labels are exploded."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("y")) for n in labels])).alias("p")
    long = rows.select("date", "sym", "bkt", *features, pairs).select("date", "sym", "bkt", "p.label", "p.y", *features)
    return complete_cases(long, ["y", *features])


def seeded_sample(rows: DataFrame, n: int, seed: int, keys: list[str], within: list[str]) -> DataFrame:
    """Exactly n rows of each group without replacement (all of a smaller group), the same ones for the same seed whatever the partitioning.

    Identical rows are counted first and each copy has a number, so a row's place, a hash of its keys and its copy's number,
    is its own however often keys repeat. A threshold on the hash drops nearly all rows beyond n before the exact cut, so the
    window sorts little more than n rows of a group.
    """
    everything = rows.columns
    copies = rows.groupBy(*everything).agg(F.count("*").alias("_m"))  # partial counts first: a hot row doesn't stand out
    others = [F.col(c) for c in everything if c not in keys]
    hashed = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m")))).withColumn("_h", F.xxhash64(*keys, *others, "_copy", F.lit(seed)))
    sizes = rows.groupBy(*within).agg(F.count("*").alias("_n"))
    share = F.lit(float(n)) / F.col("_n")
    bound = (F.least(share * 1.2 + 4 * F.sqrt(share) / F.sqrt(F.col("_n")) + 100.0 / F.col("_n"), F.lit(1.0)) * 2.0 - 1.0) * float(2**63 - 1)
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in within]
    near = hashed.alias("_l").join(sizes.alias("_s"), same).where(F.col("_h").cast("double") <= bound).select("_l.*")
    w = Window.partitionBy(*within).orderBy("_h", *everything, "_copy")
    return near.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).select(*everything)
