"""The plans of the sample queries: each step is there once."""

from waterspark.plans import sample_queries as Q
from waterspark.plans.imagery_queries import active

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_requests_are_met_once(spark):
    """Made and refused requests are one pass, and their texts are cleaned before the joins."""
    text = plan(Q.sample_create(spark, SF))
    assert "Union" not in text.split("Join")[0]
    assert "aoi_water" not in text


def test_selection_is_grouped_before_its_tiles_are_made(spark):
    assert "o_orderkey" not in plan(active(spark, SF).where("tile IS NOT NULL"))


def test_samples_are_made_once_for_the_store(spark):
    assert "Join Inner" not in plan(Q.sample_store(spark, SF))


def test_label_layers_are_made_once(spark, monkeypatch):
    calls, layers = [], Q.layers
    monkeypatch.setattr(Q, "layers", lambda *a: calls.append(a) or layers(*a))
    Q.sample_labels(spark, SF).count()
    assert len(calls) == 1
