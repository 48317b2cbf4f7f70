"""Folds, boosted trees, stored models and reports of retraining."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sedge.operators import documents as D
from sedge.plans import documents as plans


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(41)
    rows = []
    for k in range(240):
        label = k % 3 if k % 7 else 2
        rows.append((k, [label + r.gauss(0, 0.35), r.random(), -label + r.gauss(0, 0.35)], label))
    return D.stored(spark.createDataFrame(rows, "doc_id long, features array<double>, label int"), "labelled")


def test_folds_of_a_label_differ_by_one(spark, monkeypatch):
    monkeypatch.setattr(D, "FOLD_BUCKETS", 8)
    rows = spark.createDataFrame([(k, None if k % 11 == 0 else "hot" if k % 3 else f"l{k % 5}") for k in range(503)], "doc_id long, label string").repartition(5)
    for folds in (3, 5):
        counts: dict = {}
        for x in D.stratified_folds(rows, folds).groupBy("label", "fold").count().collect():
            counts.setdefault(x.label, {})[x.fold] = x["count"]
        sizes = {x.label: x["count"] for x in rows.groupBy("label").count().collect()}
        for label, n in sizes.items():
            per = [counts[label].get(k, 0) for k in range(folds)]
            assert sum(per) == n and max(per) - min(per) <= 1
    assert D.stratified_folds(rows.limit(0)).count() == 0


def test_boosted_trees_on_rows_they_have_not_seen(labelled, tmp_path):
    rows = D.stratified_folds(labelled)
    model = D.boosted(rows.where("fold > 0"), rounds=4, depth=2)
    found = D.predicted(model, rows.where("fold = 0"), 0.0).collect()
    assert sum(str(x.label) == x.predicted for x in found) / len(found) >= 0.8
    assert all(abs(sum(x.probabilities) - 1) < 1e-6 and abs(max(x.probabilities) - x.confidence) < 1e-12 for x in found)
    model.save(f"file://{tmp_path}/boosted")
    again = D.load_model(f"file://{tmp_path}/boosted", [0, 1, 2])
    assert sorted(map(str, D.predicted(again, rows.where("fold = 0"), 0.0).collect())) == sorted(map(str, found))


@pytest.mark.parametrize("name, kind, fits", [("boosted", "GBTClassifier", 2), ("fitted", "RandomForestClassifier", 1)])
def test_models_are_fitted_on_every_labelled_row(spark, monkeypatch, name, kind, fits):
    from pyspark.ml import classification

    given = []
    monkeypatch.setattr(getattr(classification, kind), "fit", lambda self, held: given.append(held.count()))
    getattr(D, name)(spark.range(60_000).selectExpr("id AS doc_id", "array(double(id)) AS features", "int(id % 2) AS label"))
    assert given == [60_000] * fits


def test_confusion_covers_every_row(labelled):
    matrix = D.cross_validated(labelled, 3, lambda x: D.fitted(x, 5, 3))
    assert matrix.agg(F.sum("n")).first()[0] == 240
    report = {x.label: x for x in D.fold_report(matrix).collect()}
    assert report[None].n == 240 and report[None].accuracy >= 0.8 and report[None].enough


def test_both_models_are_tried_on_the_same_folds(labelled, tmp_path):
    report = D.retrain_report(labelled, F.col("doc_id") < 60, f"file://{tmp_path}/models", 3, lambda x: D.fitted(x, 5, 3)).collect()
    by = {(x.model, x.label): x for x in report}
    assert {k for k in by} == {(m, c) for m in ("before", "after") for c in (0, 1, 2, None)}
    assert by["before", None].n == by["after", None].n == 240
    assert all(abs(by["after", c].gain - (by["after", c].accuracy - by["before", c].accuracy)) < 1e-12 for c in (0, 1, 2, None))
    assert D.load_model(f"file://{tmp_path}/models/after").getNumTrees == 5


@pytest.mark.parametrize("name", ["cross_validate", "train_classifier", "retrain_report"])
def test_only_labelled_documents_get_vectors(spark, sf_dir, monkeypatch, name):
    """The same vectors as among all documents, and none of documents without a label."""
    made, given, real = [], [], D.fingerprints
    monkeypatch.setattr(D, "fingerprints", lambda groups, docs: made.append(docs) or real(groups, docs))
    monkeypatch.setattr(D, "cross_validated", lambda rows, *_: given.append(rows) or spark.createDataFrame([], "label int, predicted int, n long"))
    monkeypatch.setattr(D, "retrain_report", lambda rows, *_: given.append(rows))
    getattr(plans, name)(spark, sf_dir)
    labels = {x.doc_id for x in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {x.doc_id for x in made[0].select("doc_id").collect()} <= labels
    whole = {x.doc_id: x.features for x in plans._labelled(spark, sf_dir)[1].collect()}
    assert {x.doc_id: x.features for x in given[0].collect()} == whole and whole
