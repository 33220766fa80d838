"""Cross-validation by fold, and the count that a resumable sink returns."""

from claimweave.operators import learning as LN
from claimweave.sources import writers as W


def test_each_fold_is_scored_by_the_others(spark):
    rows = [(i, f"common words {'eats' if i % 2 else 'sleeps'} w{i % 5}", float(i % 2), i % 3) for i in range(60)]
    rows += [(100 + i, "common words eats alone", 1.0, 3) for i in range(6)]  # a fold of one class
    df = spark.createDataFrame(rows, "doc_id int, text string, label double, fold int")
    got = {(r.fold, r.setting): (r.n_test, r.auc) for r in LN.cross_validate(df, 4, {"low": 0.01, "high": 0.1}).collect()}
    assert len(got) == 8 and all(got[k, s] == (20, 1.0) for k in range(3) for s in ("low", "high"))
    assert all(got[3, s][0] == 6 and got[3, s][1] is None for s in ("low", "high"))


def test_resumable_sink_returns_what_it_appends(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.range(100).withColumnRenamed("id", "k")
    assert W.write_remaining(df.where("k < 40"), path, ["k"], spark) == 40
    assert W.write_remaining(df, path, ["k"], spark) == 60
    assert W.write_remaining(df, path, ["k"], spark) == 0
    assert spark.read.parquet(path).count() == 100


def test_classifiers_share_features_made_once(spark, monkeypatch):
    import __spark_entry__ as entry

    made, fits = LN.rich_features, []
    monkeypatch.setattr(LN, "rich_features", lambda *a: fits.append(1) or made(*a))
    rows = entry.queries()["ml_02_classifiers"](spark, "/root/testdata/sf0.001").collect()
    assert len(fits) == 1 and {r.model for r in rows} == {"logistic", "linear_svm", "forest", "boosted"}
