"""Vector files: ranges of rows give back what was written, and a matrix that does not fit is an error."""

import numpy as np
import pytest

from quillmark.sources import vectors


def test_round_trip_and_shape_check(spark, tmp_path):
    rows = [(k if k % 7 else None, [float(k), 0.5 * k, -1.0] if k % 11 else None, "x") for k in range(50)]
    folder = f"file://{tmp_path}/index"
    manifest = vectors.write_vectors(spark.createDataFrame(rows, "id long, v array<double>, part string").repartition(2), "id", "v", folder, part_rows=9)
    kept = [r for r in rows if r[1]]
    assert sum(r.n_rows for r in manifest.collect()) == len(kept)
    got = vectors.read_vectors(spark, folder, range_rows=4).collect()
    assert sorted((str(r.id), list(r.vector)) for r in got) == sorted((str(i), v) for i, v, _ in kept)
    part = manifest.first().part
    np.save(f"{tmp_path}/index/{part}.npy", np.zeros((2, 3), np.float32))
    with pytest.raises(Exception, match="a matrix of shape"):
        vectors.read_vectors(spark, folder).collect()


def test_unequal_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        vectors.write_vectors(df, "id", "v", f"file://{tmp_path}/index")


def test_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    vectors.write_vectors(spark.createDataFrame([], "id long, v array<double>"), "id", "v", folder)
    assert vectors.read_vectors(spark, folder).count() == 0
