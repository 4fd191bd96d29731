"""A batch joins its statement lines before the features become text."""

from pyspark.sql import functions as F

from ledgerlens import config as C
from ledgerlens.operators import models, prep
from ledgerlens.plans import jobs
from ledgerlens.session import reliable


def _upload(spark):
    return reliable(spark.range(40).select(F.col("id").alias("Row"), *[(F.rand(i) * 9).alias(c) for i, c in enumerate(C.FEATURES)]))


def _model(spark):
    up = _upload(spark)
    scaler = reliable(prep.fit_robust_scaler(up))
    train = up.withColumn("id", F.col("Row")).withColumn(C.TARGET, (F.col("V1") > 4).cast("int"))
    return models.train_model("logistic_regression", prep.apply_robust_scaler(train, scaler)), scaler


def test_text_is_made_of_joined_rows(spark, monkeypatch):
    model, scaler = _model(spark)
    plans, cut = [], jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df, name))
    # a line number twice, one missing, and a column of the statement named like a feature
    lines = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.6), (7, "c", 0.7)], "line_no long, description string, V3 double")
    scored, summary = jobs.batch_import(spark, _upload(spark), model, scaler, statement=lines, batch_id="b")
    plan = dict(plans)["scored-batch"]
    assert 0 <= plan.index("AS v_features") < plan.index("Join")
    got = {(r["Row"], r["description"], r["V3"]) for r in scored.collect()}
    assert got == {(i, None, None) for i in range(40) if i not in (1, 7)} | {(1, "a", 0.5), (1, "b", 0.6), (7, "c", 0.7)}
    raw = {r["Row"]: r for r in _upload(spark).collect()}
    from ledgerlens.operators import clean
    text = {r["Row"]: r["t"] for r in _upload(spark).select("Row", clean.pack_features(_upload(spark)).alias("t")).collect()}
    for r in scored.collect():
        assert r["v_features"] == text[r["Row"]] and r["time_val"] == raw[r["Row"]]["Time"] and r["amount"] == raw[r["Row"]]["Amount"]
