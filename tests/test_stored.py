"""What is stored by columns is read by columns."""

from quern.sources.shared import stored


def test_readers_ask_for_their_columns_only(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", 2.0), (2, None, 3.0)], "a long, b string, c double")
    kept = stored(df, "kept")
    assert kept.schema == df.schema and kept.exceptAll(df).isEmpty() and kept.count() == 3
    assert "ReadSchema: struct<b:string>" in kept.where("b is null").select("b")._jdf.queryExecution().executedPlan().toString()


def test_the_contracts_read_stored_models_by_columns(spark, monkeypatch):
    from quern.plans import surface

    seen = []
    monkeypatch.setattr(surface, "stored", lambda df, name: seen.append(name) or stored(df, name))
    assert surface.every_contract(spark, "/root/testdata/sf0.001").count() == 42
    assert seen == ["products", "prices", "matches"]
