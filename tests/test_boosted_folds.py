"""The boosted models are fitted for each fold on all listed rows up to its origin."""

from larder.operators import boosting
from larder.plans import queries

SF = "/root/testdata/sf0.001"


def test_every_fold_on_all_history(spark, monkeypatch):
    whole = queries.fact(spark, SF)
    item = whole.agg({"item_id": "min"}).first()[0]
    small = spark.createDataFrame(whole.where(whole.item_id == item).collect(), whole.schema)
    monkeypatch.setattr(queries, "fact", lambda *_: small)
    monkeypatch.setattr(queries, "_FITS", {})
    monkeypatch.setattr(queries, "ROUNDS", 1)
    got = queries.boosted_forecast(spark, SF).select("fold", "origin_date").distinct().collect()
    folds = queries._fold_list(small)
    assert sorted(map(tuple, got)) == folds and len(folds) == 5
    fitted = next(iter(queries._FITS.values()))
    listed = queries.demand.features(small)
    for model, trees in zip(fitted.models, fitted.trees, strict=True):
        n = listed.where(listed.date <= model.origin).count()
        assert [t.cover[0] for t in trees] == [n, n]
    assert {(m.fold, m.origin) for m in fitted.models} == set(folds) and len(fitted.models) == 5 * 8
    assert isinstance(fitted, boosting.Boosted)
