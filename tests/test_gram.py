import numpy as np
import pytest

from panelflow.functions.numeric import lasso, lasso_ic
from panelflow.operators import gram, varmodels


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(260, 5)) * [1, 2, 0.5, 1, 1] + [0, 1, 0, -3, 0]
    for t in range(2, 260):
        x[t, 1] += 0.6 * x[t - 1, 0] - 0.3 * x[t - 2, 4]
    return x


def rows_of(spark, x):
    return spark.createDataFrame([(f"s{j}", 3 * i + 7, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "series string, bar long, ret double")


def design(x, lags):
    names = ["1", *(gram.column_name(k, f"s{j}") for k in range(lags + 1) for j in range(x.shape[1]))]
    return names, np.column_stack([np.ones(len(x) - lags), *[x[lags - k : len(x) - k] for k in range(lags + 1)]])


@pytest.mark.parametrize("tile", [(4096, 128, 64), (50, 2, 2), (7, 1, 3)])
def test_tiles_add_up_to_the_whole_product(spark, panel, monkeypatch, tile):
    for name, v in zip(("TILE_BARS", "TILE_SERIES", "TILES"), tile, strict=True):
        monkeypatch.setattr(gram, name, v)
    names, z = design(panel, 2)
    cells = {(r["a"], r["b"]): r["value"] for r in gram.gram_cells(gram.gram(rows_of(spark, panel), 2)).collect()}
    assert len(cells) == len(names) ** 2
    want = z.T @ z
    assert all(cells[a, b] == pytest.approx(want[i, j], abs=1e-8) for i, a in enumerate(names) for j, b in enumerate(names))


@pytest.mark.parametrize("screen", [2048, 3])
@pytest.mark.parametrize("criterion", ["bic", "aic"])
def test_fits_are_those_on_the_panel_itself(spark, panel, monkeypatch, screen, criterion):
    """With all columns at once, and with a screen that leaves some out at first."""
    monkeypatch.setattr(gram, "SCREEN", screen)
    coefs = varmodels.lasso_var(rows_of(spark, panel), lags=2, criterion=criterion).collect()
    assert len(coefs) == 5 * 10
    x = np.column_stack([panel[1:-1], panel[:-2]])
    for j in range(5):
        got = {(r["lag"], r["source"]): r["coef"] for r in coefs if r["target"] == f"s{j}"}
        used = next(r["alpha"] for r in coefs if r["target"] == f"s{j}")
        y = panel[2:, j] - panel[2:, j].mean()
        b, alpha = lasso_ic(x - x.mean(0), y, criterion)
        found = np.array([got[k, f"s{i}"] for k in (1, 2) for i in range(5)])
        if screen > 10:
            assert used == pytest.approx(alpha, abs=1e-12) and np.allclose(found, b, atol=1e-9)
        else:  # a knot of the same path, chosen by its own noise
            assert np.allclose(found, lasso(x - x.mean(0), y, used, max_iter=100_000, tol=1e-13), atol=1e-7)


def test_agrees_with_the_library_for_a_given_penalty(spark, panel):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    coefs = {(r["lag"], r["source"]): r["coef"] for r in varmodels.lasso_var(rows_of(spark, panel), lags=1, alpha=0.1).where("target = 's1'").collect()}
    df = spark.createDataFrame([(float(y), *map(float, x)) for x, y in zip(panel[:-1], panel[1:, 1], strict=True)], ["y", *"abcde"])
    df = VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df)
    # the library divides the target by its deviation, so its penalty is on that scale
    model = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=0.1, standardization=False, tol=1e-12, maxIter=1000).fit(df)
    assert np.allclose([coefs[1, f"s{i}"] for i in range(5)], model.coefficients.toArray(), atol=1e-3)
