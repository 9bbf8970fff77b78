"""Fits of classifiers: rows of one file are dealt to all cores, small tables stay, the fits of one model run side by side."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from tabsonde.operators import models


def test_large_tables_are_dealt_out(spark, monkeypatch):
    rows = spark.range(1200).coalesce(1)
    assert models._spread_rows(rows).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    dealt = models._spread_rows(rows)
    assert dealt.rdd.getNumPartitions() == 12 and dealt.distinct().count() == 1200


def test_fits_run_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(models.FITS_AT_ONCE, timeout=60)
    stages = models._stages

    def waiting(*args):
        meet.wait()  # breaks if a fit waits for the one before
        return stages(*args)

    monkeypatch.setattr(models, "_stages", waiting)
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("y"))
    got = models.evaluate_models(df, "y", ["id"], ["x"], models=["linear"]).first()
    assert got.score == 1.0 and got.cv_score == 1.0
