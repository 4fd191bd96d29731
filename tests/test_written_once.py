"""Work that is done once: scoring before an evaluation, node ids of a forest, the cells of workbooks."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from ledgerlens import config as C
from ledgerlens.operators import models
from ledgerlens.plans import jobs, sheets


def rows_of(spark, n=240):
    x = np.random.default_rng(7).normal(size=(n, len(C.FEATURES)))
    rows = [(i, *map(float, r), int(r[0] + r[1] > 0.5)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"`{c}` double" for c in C.FEATURES) + f", {C.TARGET} int")


def test_models_score_a_row_once(spark, monkeypatch):
    scored_rows = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(y):
        scored_rows.add(1)
        return y

    told = models.Fitted.predict
    monkeypatch.setattr(models.Fitted, "predict", lambda self, df: told(self, df).withColumn("prediction", seen.asNondeterministic()("prediction")))
    df = rows_of(spark)
    scored, _ = jobs.run_models(df, df, ["logistic_regression"], "none")
    table = jobs.comparison(scored)
    assert table.first()["accuracy"] > 0.8 and table.count() == 1
    assert scored_rows.value == 240


def test_forest_caches_node_ids_and_stays_the_same(spark):
    df = rows_of(spark).coalesce(1)
    spec = models.make_model("random_forest", {"n_estimators": 5})
    got = models.train_model(spec, df).model.stages[-1]
    assert got.getCacheNodeIds()
    est = RandomForestClassifier(labelCol=C.TARGET, numTrees=5, maxDepth=models.SPARK_MAX_DEPTH, minInstancesPerNode=1, seed=42, weightCol="weight")
    weighted = models.balanced_weights(df, C.TARGET, "weight").withColumn(C.TARGET, F.col(C.TARGET).cast("double"))
    want = Pipeline(stages=[models.assembler(), est]).fit(weighted).stages[-1]
    assert [t.toDebugString.split("\n", 1)[1] for t in got.trees] == [t.toDebugString.split("\n", 1)[1] for t in want.trees]


def test_technical_rows_shuffle_their_cells_once(spark):
    names = list(reversed(C.REQUIRED_UPLOAD))
    tech = lambda f, head: [(f, "Du lieu ky thuat", 1, 3, head), *[(f, "Du lieu ky thuat", 1, 4 + i, [f"{f}{i}:{c}" for c in head]) for i in range(2)]]
    rows = [*tech("a", names), *tech("b", ["x" if c == "V5" else c for c in names]), *tech("c", ["x", None]),
            ("a", "Du lieu ky thuat", 1, 9, None), ("a", "Du lieu ky thuat", 1, 10, names), ("a", "Sao ke", 0, 0, names), ("d", "Ghi chu", 2, 1, names)]
    df = spark.createDataFrame(rows, "file string, sheet string, sheet_no int, row_no long, cells array<string>")
    picks = spark.createDataFrame([(f, "Du lieu ky thuat") for f in "abc"], "file string, tech_sheet string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = sheets.technical_rows(df, picks)
        got = {(r.file, r.row_no): r for r in out.collect()}
        wide = [x for x in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "Aggregate" in x and "min_by(cells" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert set(got) == {("a", 4), ("a", 5), ("a", 9), ("a", 10), ("b", 4), ("b", 5), ("c", 4), ("c", 5)}
    assert got["a", 4]["V5"] == "a0:V5" and got["a", 5]["Time"] == "a1:Time" and got["a", 9]["V5"] is None and got["a", 10]["V1"] == "V1"
    assert got["a", 4]["absent"] == [] and got["b", 4]["absent"] == ["V5"] and got["b", 4]["V5"] is None and got["b", 4]["V6"] == "b0:V6"
    assert got["c", 4]["absent"] == list(C.REQUIRED_UPLOAD)
    assert not wide


def test_an_upload_is_parsed_once_and_numbered_by_one_shuffle(spark, monkeypatch):
    """Cells are not parsed for the filter as well, and no window sorts the wide rows again."""
    plans, cut = {}, jobs.cut_lineage

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(jobs, "cut_lineage", seen)
    df = rows_of(spark)
    train, _, scaler = jobs.prepared(spark, df)
    model = models.train_model("logistic_regression", train)
    cells = {c: F.col(c).cast("string") for c in C.REQUIRED_UPLOAD}
    bad = F.when(F.col("id") % 6 == 0, F.element_at(F.array(*[F.lit(x) for x in ("1d", "abc", "nan", "2F\n")]), (F.col("id") / 6 % 4 + 1).cast("int"))).otherwise(cells["Amount"])
    upload = df.select(F.col("id").alias("Row"), *[(bad if n == "Amount" else c).alias(n) for n, c in cells.items()])
    scored, summary = jobs.batch_import(spark, upload, model, scaler)
    got = {r.Row: r.row_no for r in scored.collect()}
    assert got == {i: n for n, i in enumerate((i for i in range(240) if i % 6), 1)} and summary.first()["total"] == 200
    assert "Filter" not in plans["upload"] and "Window" not in plans["scored-batch"].replace("Window [sum(_n", "")
