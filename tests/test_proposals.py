from pyspark.sql import functions as F

from sigmill.operators import proposals


def factors(spark, n=30):
    rows = [(f"c{i:02d}", f"f{i % 3}", i % 4 == 0, 0.1 * i, 0.05 * i, 0.02 * i, 0.3 - 0.005 * i, 6 if i % 2 else 96, 1) for i in range(n)]
    return spark.createDataFrame(rows, "candidate_id string, family string, passed boolean, research_score double, gross_sharpe double, net_sharpe double, turnover double, lookback long, smooth_span long")


def test_rounds_of_proposals(spark):
    seen = []

    def evaluate(children):  # calmer and longer is better, up to a point
        seen.append(children.count())
        score = F.log2("smooth_span") / 3 + F.when(F.col("lookback") == 48, 1.0).otherwise(0.0)
        return children.select("candidate_id", (score + 3).alias("research_score"), score.alias("net_sharpe"), (1 / F.col("smooth_span")).alias("turnover"), F.lit(True).alias("passed"))

    got = proposals.optimise(factors(spark), evaluate, rounds=3)
    rows = got.collect()
    assert len(seen) == 3 and seen[0] and seen[1] and len(rows) == 30 + sum(seen) == len({r.candidate_id for r in rows})
    by = {r.candidate_id: r for r in rows}
    for r in rows:
        if r.round:
            parent = by[r.parent_id]
            assert r.changed and r.status in ("improved", "failed", "neutral") and r.root_parent_id == (parent.root_parent_id or parent.candidate_id)
            for c in r.changed:
                assert getattr(r, c) != getattr(parent, c)
            assert all(getattr(r, c) == getattr(parent, c) for c in ("smooth_span", "lookback") if c not in r.changed)
    assert max(r.net_sharpe for r in rows if r.round) > max(r.net_sharpe for r in rows if not r.round)


def test_few_or_none(spark):
    none = factors(spark).where("false")
    assert proposals.composites(none).count() == proposals.evolve(none).count() == proposals.exits(none).count() == 0
    one = proposals.composites(factors(spark).limit(1).withColumn("passed", F.lit(True))).collect()
    assert [(r.subset, r.weight) for r in one] == [("top8", 1.0)]
    assert [r.lookback for r in proposals.evolve(factors(spark).where("candidate_id = 'c00'")).where("variant = 'lookback'").collect()] == [48]
