"""Training sets of the experts against pandas."""

import numpy as np
import pandas as pd
import pytest

from shopfloor.operators.series import Series
from shopfloor.plans.experts import expert_dataset


@pytest.mark.parametrize("width, ahead", [(3, 7), (1000, 7), (7, 40)])
def test_expert_dataset_against_pandas(spark, width, ahead):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"m": 1, "i": np.sort(rng.choice(300, 43, replace=False)), "a": rng.random(43), "b": rng.random(43), "w": rng.random(43)})
    df = spark.createDataFrame([tuple(r) for r in pdf.astype({"m": int, "i": int}).itertuples(index=False)], "m long, i long, a double, b double, w double")
    got = expert_dataset(df, Series(("m",), ("i",), width), ["a", "b"], ["b"], "w", 5, ahead).toPandas().sort_values("i")

    label = pdf["w"].rolling(ahead, min_periods=1).max().shift(-ahead).fillna(0)
    cut = int(len(pdf) * 0.8)
    train = pdf[["a", "b"]].iloc[:cut]
    scaled = (pdf[["a", "b"]] - train.mean()) / train.std(ddof=0)
    ends = [e for e in range(4, 43) if not cut <= e < cut + 4]
    assert got["i"].tolist() == pdf["i"].iloc[ends].tolist()
    assert got["is_train"].tolist() == [e < cut for e in ends]
    np.testing.assert_allclose(got["label"], label.iloc[ends])
    np.testing.assert_allclose(got["b"], scaled["b"].iloc[ends])
    for e, window in zip(ends, got["window"]):
        np.testing.assert_allclose([list(x) for x in window], scaled.iloc[e - 4 : e + 1].to_numpy())


def test_expert_dataset_of_few_rows_is_empty(spark):
    schema = "m long, i long, a double, w double"
    for rows in ([], [(1, 1, 1.0, 1.0), (1, 2, 2.0, None)]):
        df = spark.createDataFrame(rows, schema)
        assert expert_dataset(df, Series(("m",), ("i",), 10), ["a"], [], "w", 5, 3).count() == 0
