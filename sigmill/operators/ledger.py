"""Metadata tables as append-only Parquet with latest-per-key views (single writer)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(df: DataFrame, key: str | list[str], at: str = "updated_at") -> DataFrame:
    """The newest row of each key."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *[F.col(c).desc() for c in df.columns if c not in keys and c != at and dict(df.dtypes)[c] != "map"])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def record_trials(old: DataFrame, new: DataFrame) -> DataFrame:
    """New trials whose id is not there yet; lineage defaults to the candidate."""
    n = new.withColumns({"family": F.lower(F.trim("family")), "lineage_id": F.coalesce("lineage_id", "candidate_id")})
    return n.dropDuplicates(["trial_id"]).join(old.select("trial_id"), "trial_id", "left_anti")


def trial_counts(trials: DataFrame, now: Column, *, days: int = 90) -> DataFrame:
    """Per family: distinct lineages ever, distinct lineages of all families in the window and ever, and the larger of the first two."""
    recent = F.col("evaluated_at") >= now - F.expr(f"interval {days} days")
    overall = trials.agg(F.count_distinct(F.when(recent, F.col("lineage_id"))).alias("rolling"), F.count_distinct("lineage_id").alias("global"), F.lit(1).alias("_k"))
    per = trials.groupBy("family").agg(F.count_distinct("lineage_id").alias("family_count"), F.lit(1).alias("_k"))
    return per.join(F.broadcast(overall), "_k").drop("_k").withColumn("effective", F.greatest("family_count", "rolling"))


def migrate_lineage(trials: DataFrame, patterns: list[str], bucket: str = "legacy") -> DataFrame:
    """Lineages that match a pattern (with * for anything) move to one bucket."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("lineage_id").rlike("^" + ".*".join(re.escape(x) for x in p.split("*")) + "$")
    return trials.withColumn("lineage_id", F.when(hit, F.lit(bucket)).otherwise(F.col("lineage_id")))


def archive(trials: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) by evaluation time; write both, then swap."""
    old = F.col("evaluated_at") < before
    return trials.where(~old), trials.where(old)


def delete_prefix(df: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return df.where(~F.col(key).startswith(prefix))


def prune(df: DataFrame, keep: int, protected: DataFrame, *, key: str = "key", at: str = "updated_at") -> DataFrame:
    """The newest ``keep`` rows, and all protected keys."""
    top = df.orderBy(F.col(at).desc(), key).limit(keep).select(key)
    return df.join(top.unionByName(protected.select(key)).distinct(), key, "left_semi")


def newest(df: DataFrame, n: int, at: str = "updated_at") -> DataFrame:
    return df.orderBy(F.col(at).desc(), *[c for c in df.columns if c != at]).limit(n)


def event_sequence(events: DataFrame, run: str = "run_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add seq, from 1 within each run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(at, tie)))


def upsert_survivors(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows over old ones by candidate_id; the start of paper trading is kept."""
    o = old.select("candidate_id", *[F.col(c).alias(f"_{c}") for c in old.columns if c != "candidate_id"])
    j = o.join(new, "candidate_id", "full_outer")
    pick = lambda c: F.coalesce(f"_{c}", c) if c == "paper_trade_start" else F.coalesce(c, f"_{c}")
    return j.select("candidate_id", *[pick(c).alias(c) for c in old.columns if c != "candidate_id"])


def operator_class(df: DataFrame) -> DataFrame:
    """Add operator and operator_detail from candidate_type, kind, generated_by, parent_id, lab_direction."""
    t, kind, by = (F.coalesce(c, F.lit("")) for c in ("candidate_type", "kind", "generated_by"))
    born = F.col("parent_id").isNotNull()
    lab = F.coalesce("lab_direction", F.lit(False))
    # Fixed values: (condition, operator, detail), the first that holds.
    table = [
        ((t == "original") & born, "MUTATION_AT_DSL", "OPTIMIZER_EVOLUTION"),
        ((t == "original") & lab, "SEED_INFORMED", "LAB_DIRECTION"),
        (t == "original", "SEED", None),
        (t == "grid_tuning", "MUTATION_AT_DSL", "GRID_TUNING"),
        (t == "repair", "MUTATION_AT_DSL", "PRE_GATE_REPAIR"),
        (t == "composite", "CROSSOVER", "COMPOSITE_EQUI_WEIGHT"),
        ((t == "optimizer") & ((kind == "crossover") | (by == "crossover_dsl_composite")), "CROSSOVER", "DSL_COMPOSITE"),
        ((t == "optimizer") & (kind == "mutation_at_mechanism"), "MUTATION_AT_MECHANISM", "LLM_MECHANISM_MUTATION"),
        ((t == "optimizer") & (kind == "mutation_at_hypothesis"), "MUTATION_AT_HYPOTHESIS", "LLM_HYPOTHESIS_MUTATION"),
        ((t == "optimizer") & (kind == "hill_climb"), "MUTATION_AT_DSL", "OPTIMIZER_HILL_CLIMB"),
        ((t == "optimizer") & (kind == "local_grid_tuning"), "MUTATION_AT_DSL", "GRID_TUNING"),
        ((t == "optimizer") & ((kind == "repair") | (~kind.isin("evolution", "turnover_control") & by.isin("near_miss_repair", "optimizer_repair"))), "MUTATION_AT_DSL", "PRE_GATE_REPAIR"),
        ((t == "optimizer") | born, "MUTATION_AT_DSL", "OPTIMIZER_EVOLUTION"),
    ]
    op, detail = F.lit("SEED"), F.lit(None).cast("string")
    for cond, o, d in reversed(table):
        op, detail = F.when(cond, F.lit(o)).otherwise(op), F.when(cond, F.lit(d).cast("string")).otherwise(detail)
    return df.withColumns({"operator": op, "operator_detail": detail})


def success_report(trajectories: DataFrame) -> DataFrame:
    """Per operator: rows, promotion rate, survivor rate, mean depth."""
    return trajectories.groupBy("operator").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("outcome") == "promoted").cast("double")).alias("promoted_rate"),
        F.avg(F.col("outcome").isin("promoted", "survivor").cast("double")).alias("survivor_rate"), F.avg(F.size("parent_ids").cast("double")).alias("depth"),
    )


def uplift(trajectories: DataFrame, base: str = "SEED", *, least: int = 20, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Promoted-rate difference of each operator to ``base``, with a bootstrap interval.

    Resampling a 0/1 outcome is a binomial draw, so only counts are needed.
    """
    import numpy as np

    counts = trajectories.groupBy("operator").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "promoted").alias("k")).withColumn("_g", F.lit(1))

    def run(pdf):
        r = np.random.default_rng(seed)
        pdf = pdf.sort_values("operator")
        got = pdf[pdf["operator"] == base]
        if got.empty or got["n"].iloc[0] < least:
            return pdf.iloc[:0].assign(uplift=0.0, low=0.0, high=0.0)[["operator", "n", "uplift", "low", "high"]]
        n0, k0 = int(got["n"].iloc[0]), int(got["k"].iloc[0])
        rows = []
        for o, n, k in pdf[["operator", "n", "k"]].itertuples(index=False):
            if o != base and n >= least:
                d = r.binomial(n, k / n, resamples) / n - r.binomial(n0, k0 / n0, resamples) / n0
                rows.append((o, n, k / n - k0 / n0, *np.quantile(d, (0.05, 0.95))))
        import pandas as pd

        return pd.DataFrame(rows, columns=["operator", "n", "uplift", "low", "high"])

    return counts.groupBy("_g").applyInPandas(run, "operator string, n long, uplift double, low double, high double")


def write_bundle(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Archive of JSON lines, each with a hash of its payload."""
    payload = F.to_json(F.struct(*rows.columns))
    rows.select(F.to_json(F.struct(payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))).alias("value")).write.mode("overwrite").text(path)


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """payload and valid of each archived line."""
    d = spark.read.text(path).select(F.from_json("value", "payload string, sha256 string").alias("x")).select("x.*")
    return d.select("payload", (F.sha2("payload", 256) == F.col("sha256")).alias("valid"))
