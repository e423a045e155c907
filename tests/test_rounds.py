"""The query of models boosts as long as the operators do by default."""

from phonolith.operators import models
from phonolith.plans import queries


def test_q44_leaves_no_rounds_out(spark, monkeypatch):
    asked = []

    def short(kind):
        return lambda **settings: asked.append(settings["maxIter"]) or kind(**settings | {"maxIter": 1})

    for name in ("GBTRegressor", "GBTClassifier"):
        monkeypatch.setattr(models, name, short(getattr(models, name)))
    found = {r.name: r.value for r in queries.QUERIES["q44_models"](spark, "/root/testdata/sf0.001").collect()}
    assert asked == [models.ROUNDS] * 2 == [300, 300]
    assert list(found) == ["r2_baseline", "r2_ridge", "r2_trees", "p_low", "p_high"] and 0 <= found["p_low"] <= found["p_high"] <= 1
