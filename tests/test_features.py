import numpy as np
from pyspark.ml.functions import vector_to_array

from phenospark.operators import features as FT
from phenospark.operators.cohort import CohortRules, label_cohort
from phenospark.operators.metrics import attach_labels, purity


def tuples(spark):
    return spark.createDataFrame(
        [(1, "a", "x", 2.0), (1, "b", "x", 5.0), (2, "a", "x", 4.0), (3, "a", "y", 1.0), (3, "b", "x", 5.0), (2, "b", "x", 5.0)],
        "subject_id long, source string, feature string, value double")


def test_counts_averages_and_candidates(spark):
    diag = spark.createDataFrame([(1, "A1"), (1, "A1"), (2, "b2"), (2, "C3")], "subject_id long, code string")
    wanted = spark.createDataFrame([("a1",), ("B2",)], "item string")
    got = {(r["subject_id"], r["feature"]): r["value"] for r in FT.diagnostic_features(diag, wanted).collect()}
    assert got == {(1, "A1"): 2.0, (2, "b2"): 1.0}
    lab = spark.createDataFrame([(1, "t", 1.0), (1, "t", 2.0)], "subject_id long, test_name string, value double")
    assert FT.lab_features(lab).first()["value"] == 1.5


def test_equal_names_of_two_sources_stay_apart(spark):
    vectors, axis = FT.feature_vectors(tuples(spark))
    assert axis.size == 3
    got = {r["subject_id"]: list(r["v"]) for r in vectors.select("subject_id", vector_to_array("features").alias("v")).collect()}
    assert got == {1: [2.0, 0.0, 5.0], 2: [4.0, 0.0, 5.0], 3: [0.0, 1.0, 5.0]}


def test_scaling_counts_absent_cells_as_zero(spark):
    vectors, axis = FT.feature_vectors(tuples(spark))
    dense = np.array([[2, 0, 5], [4, 0, 5], [0, 1, 5]], dtype=float)
    sd = dense.std(axis=0, ddof=1)
    want = np.divide(dense, sd, out=np.zeros_like(dense), where=sd > 0)
    scaled = FT.scale_vectors(vectors).select("subject_id", vector_to_array("scaled").alias("v")).orderBy("subject_id").collect()
    np.testing.assert_allclose([list(r["v"]) for r in scaled], want)
    for size in (axis.size, None):
        long = FT.scale_features(FT.feature_matrix_long(tuples(spark), axis), size)
        for r in long.collect():
            assert abs(r["value"] - want[r["subject_id"] - 1, r["idx"]]) < 1e-12


def test_purity(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 2), (1, 2)], "cluster int, label int")
    row = purity(df).first()
    assert (row["purity"], row["n"]) == (0.8, 5)


def test_rows_without_label_do_not_count(spark):
    assigned = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "subject_id long, cluster int")
    labels = spark.createDataFrame([(1, 1), (3, 1)], "subject_id long, label int")
    assert purity(attach_labels(assigned, labels)).first()["n"] == 2


def test_cohort_rules(spark):
    rules = CohortRules(("T",), ("X",), ("R", "T"), ("drug_t",), ("drug_x",), ("glucose",), {"glucose": 110.0})
    med = spark.createDataFrame(
        [(1, "drug_t", "2020-01-01"), (1, "drug_x", "2020-02-01"), (2, "drug_t", "2020-02-01"), (2, "drug_x", "2020-01-01"),
         (8, "drug_x", "2020-01-01"), (10, "drug_t", "2020-01-01"), (10, "drug_x", "2020-01-01")],
        "subject_id long, med_name string, date string").selectExpr("subject_id", "med_name", "to_date(date) as date")
    lab = spark.createDataFrame(
        [(4, "glucose", 90.0), (5, "glucose", 120.0), (6, "glucose", 90.0), (9, "other", 1.0)],
        "subject_id long, test_name string, value double").selectExpr("*", "date'2020-01-01' as date")
    diag = spark.createDataFrame(
        [(1, "T"), (2, "T"), (3, "T"), (3, "X"), (6, "R"), (7, "T"), (8, "T"), (10, "T")],
        "subject_id long, code string").selectExpr("*", "date'2020-01-01' as date")
    got = {r["subject_id"]: r["label"] for r in label_cohort(med, lab, diag, rules).collect()}
    # 1 target drug first; 2 excluded drug first; 3 excluded code; 4 clean lab; 5 abnormal lab;
    # 6 related code; 7 no drugs; 8 only the excluded drug; 9 no screening; 10 both on one day
    assert got == {1: 1, 2: 3, 3: 3, 4: 2, 5: 3, 6: 3, 7: 1, 8: 1, 9: 3, 10: 3}
