"""Serving operators on the cases between the fixtures."""

from ionforge.operators import profiles
from ionforge.plans import flows
from ionforge.operators import scoring

SF = "/root/testdata/sf0.001"


def test_neighbours_across_gaps(spark):
    states = spark.createDataFrame([(1, 0, "a", 1), (1, 10, "b", 2), (1, 20, "c", 3), (2, 5, "d", 4)],
                                   "profile_id int, pos int, formula string, spacegroup_number int")
    got = {(r.profile_id, r.pos): (r.formula_charge, r.formula_discharge) for r in profiles.states_to_intervals(states).collect()}
    assert got == {(1, 0): ("a", "b"), (1, 10): ("b", "c")}


def test_violations_across_gaps(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (1, 3, 3.0, 4.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "profile_id int, pos int, start double, end double").selectExpr(
        "*", "'Li' AS working_ion", "'svr' AS model_family", "'auto' AS training_population", "'h' AS host", "1.0 AS value",
        "1 AS spacegroup_number_charge", "1 AS spacegroup_number_discharge", "'c' AS crystal_system_charge", "'c' AS crystal_system_discharge")
    got = {(r.profile_id, r.pos): r.violations for r in profiles.profile_contiguity(table).collect()}
    assert got[(1, 3)] == ["gap_or_overlap"] and got[(1, 1)] == []
    steps = {(r.profile_id, r.pos): r.x1 for r in profiles.profile_steps(table).collect()}
    assert steps[(2, 0)] is None and steps[(1, 0)] is not None


def test_every_request_is_scored_or_rejected(spark):
    from pyspark.sql import functions as F
    clean = flows.clean_requests(spark, SF)
    odd = clean.withColumn("model_family", F.when(F.col("request_id") % 3 == 0, "dnn").otherwise(F.col("model_family")))
    odd = odd.withColumn("formula_charge", F.when(F.col("request_id") % 7 == 0, "Fe(OH").otherwise(F.col("formula_charge")))
    defaults, models = flows.defaults(spark), flows.linear_models(spark)
    scored = scoring.score_batch(odd, defaults, models).select("request_id")
    rejected = scoring.rejected_requests(odd, defaults, models).select("request_id")
    assert scored.count() + rejected.count() == odd.count()
    assert scored.intersect(rejected).count() == 0 and rejected.count() > 0


def constant(value):
    """A fitted model that gives every row the same."""
    import numpy as np
    from ionforge.operators.trees import Ensemble, TreeSettings
    return Ensemble(value, TreeSettings(), np.zeros(740), np.ones(740))


def test_one_pass_scores_with_the_model_of_each_route(spark):
    requests = flows.requests(spark, SF).where("request_id < 400")
    models = {("li_only", "krr"): constant(1000.0), ("mixed_ions", "svr"): constant(2000.0)}
    rows = scoring.outcomes(requests, flows.defaults(spark), models).collect()
    assert len(rows) == requests.count() == len({r.request_id for r in rows})
    for r in rows:
        if r.outcome == "scored":
            plus = {("li_only", "krr"): 1000.0, ("mixed_ions", "svr"): 2000.0}[r.population, r.family]
            assert r.reason is None and r.prediction == plus
        else:
            assert r.prediction is None and r.reason
    reasons = {r.reason for r in rows}
    assert scoring.NO_MODEL in reasons and any("unsupported_ion" in x for x in reasons if x) and any("formula" in x for x in reasons if x)


def test_a_restarted_batch_counts_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from ionforge.streaming.score import accounting_path, read_requests, score_stream
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    flows.requests(spark, SF).where("request_id < 300").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for run in range(2):  # a lost checkpoint replays every batch under its old number
        stream = read_requests(spark, source, schema, files_per_trigger=1)
        score_stream(stream, flows.defaults(spark), flows.linear_models(spark), output, str(tmp_path / f"progress{run}")).awaitTermination()
    rows = spark.read.parquet(output)
    total = spark.read.parquet(source).count()
    assert rows.count() == rows.select("request_id").distinct().count() == total
    found = spark.read.parquet(accounting_path(output)).agg(*[F.sum(c) for c in ("requests", "outcomes", "scored", "rejected")]).first()
    assert found[0] == found[1] == total and found[2] + found[3] == total and found[2] == rows.where("outcome = 'scored'").count()


def test_a_non_finite_prediction_is_an_error(spark):
    import pytest
    models = {("mixed_ions", "svr"): constant(float("nan"))}
    with pytest.raises(Exception, match="non-finite"):
        scoring.score_batch(flows.clean_requests(spark, SF), flows.defaults(spark), models).collect()


def test_a_batch_of_one_file_is_dealt_over_all_tasks(spark, tmp_path):
    from ionforge.streaming.score import read_requests, score_stream
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    flows.clean_requests(spark, SF).coalesce(1).write.parquet(source)
    stream = read_requests(spark, source, spark.read.parquet(source).schema)
    score_stream(stream, flows.defaults(spark), flows.linear_models(spark), output, str(tmp_path / "progress")).awaitTermination()
    rows = spark.read.parquet(output)
    assert rows.count() == spark.read.parquet(source).count() and len(rows.inputFiles()) >= spark.sparkContext.defaultParallelism
