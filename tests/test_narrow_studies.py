"""Studies store the columns they need, and no row per model."""

from veridra import registry
from veridra.plans import q_models
from veridra.sources.workspace import stored

D = "/root/testdata/sf0.001"


def test_no_study_stores_tags_or_predictions_on_its_way(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q_models, "stored", lambda df, *a: (seen.append(set(df.columns)), stored(df, *a))[1])
    for name in ("mean_model", "left_join_complete", "union_frames", "error_by_tag"):
        registry.queries()[name](spark, D)
    assert len(seen) == 4
    assert not any({"tags", "predicted"} & columns for columns in seen)
