"""The registered queries do the whole job: the library's defaults, every feature, whole presets."""

import inspect

import pytest

from checks import operator_queries as oq
from dailybars.operators import filters, models


class Called(Exception):
    pass


def asked(monkeypatch, query, name):
    """Arguments with which a query calls a function of ``models``, with the defaults filled in."""
    of = inspect.signature(getattr(models, name))

    def stop(*args, **kw):
        bound = of.bind(*args, **kw)
        bound.apply_defaults()
        raise Called(bound.arguments)

    class Rows:
        withColumn = unionByName = lambda self, *_: self

    monkeypatch.setattr(oq, "matrix", lambda *_: Rows())
    monkeypatch.setattr(oq.F, "lit", lambda v: v)
    monkeypatch.setattr(models, "logistic_baseline", lambda *_: None)
    monkeypatch.setattr(models, name, stop)
    with pytest.raises(Called) as got:
        query(None, None)
    return got.value.args[0]


def test_models(monkeypatch):
    grown = asked(monkeypatch, oq.f04, "boosted")
    assert (grown["trees"], grown["depth"], grown["rate"], grown["features"]) == (models.TREES, models.DEPTH, models.RATE, oq.X)
    search = asked(monkeypatch, oq.f05, "random_search")
    assert search["n_iter"] == 20 and search["folds"] == 3 and (search["space"] or models.SPACE) == models.SPACE
    assert asked(monkeypatch, oq.f11, "permutation_importance")["features"] == oq.X


def test_presets_and_effects():
    assert oq.WHOLE["recommended"] == filters.RECOMMENDED_FILTERS and oq.WHOLE["default"] == filters.DEFAULT_FILTERS
    assert {f for p in oq.WHOLE.values() for f, _, _ in p if f in oq.V3} <= set(oq.WIDE)
    assert {"b16_whole_presets", "p15_latest_all_filters", "s03_top_20_effects"} <= set(oq.QUERIES)
    assert "volatility_21d < 0.08" in oq.SQL["p15_latest_all_filters"] and len(oq.EFFECTS) > 20
