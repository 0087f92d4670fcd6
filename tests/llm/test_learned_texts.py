"""Fitting the quality model moves the texts it learns from and no others."""

from tidemark.llm import quality


def test_only_chosen_texts_are_shuffled(spark, monkeypatch):
    plans = []
    made = spark.createDataFrame([(i, f"text {'good' if i % 2 else 'bad'} {i}") for i in range(200)] + [(7, "again"), (None, "x")], "doc_id long, text string")
    rated = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 5)] + [(7, None), (None, 1)], "doc_id long, grade int")
    kept = type(made).join

    def join(self, other, *args, **kwargs):
        out = kept(self, other, *args, **kwargs)
        plans.append((out, out._jdf.queryExecution().executedPlan().toString()))
        return out

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(type(made), "join", join)
    try:
        quality.fit(rated, made, "doc_id", "text", "grade", 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (learned, plan), = plans
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.id for r in learned.collect()} == set(range(0, 200, 5))
