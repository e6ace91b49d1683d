from sigmill.__main__ import main

from .test_operators import row, walk


def test_commands(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    spark.createDataFrame(walk(120)).write.parquet(at("bars"))
    assert main(["signal", at("bars"), "TS_ZSCORE($close, 20)", at("sig")], spark) == 0
    sig = spark.read.parquet(at("sig"))
    assert sig.count() == 120
    sig.selectExpr("'c' as candidate_id", "*").write.parquet(at("many"))
    assert main(["backtest", at("bars"), at("many"), at("path"), "--entry-band", "0.5", "--exit-band", "0.1"], spark) == 0
    assert "net_return" in spark.read.parquet(at("path")).columns
    row(spark).write.parquet(at("res"))
    assert main(["gates", at("res"), at("items")], spark) == 0 and spark.read.parquet(at("items")).count() == 15
    assert main(["score", at("res"), at("score")], spark) == 0 and spark.read.parquet(at("score")).first().score > 0
    assert main(["archive", at("res"), at("bundle")], spark) == 0 and main(["verify", at("bundle")], spark) == 0
    main(["methods"], spark)
    main(["quality", at("bars")], spark)
    said = capsys.readouterr().out
    assert "grid_search" in said and "ohlc_invariant" in said
