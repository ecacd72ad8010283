"""Bins read their events once for each stored input."""

from driftline.operators import binning


def test_bins_read_events_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "pid string, time double, feature_name string, value double, treated int"
    rows = spark.createDataFrame([("P1", 0.5, "purchase", 3.0, 0), ("P1", 1.5, "purchase", 5.0, 1)], schema)
    made = binning.aggregate_to_bins(rows.mapInArrow(counted, schema), spark.createDataFrame([("P1", 3.0)], "pid string, Tmax double"), ["purchase"]).orderBy("bin_idx").collect()
    assert [(r["bin_idx"], r["treatment"], r["purchase"]) for r in made] == [(0, 0, 3.0), (1, 0, 5.0), (2, 1, 5.0)]
    assert seen.value == 4
