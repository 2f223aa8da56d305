"""Rule-based cohort labels: case, control or other for every patient."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Label numbers.
CASE, CONTROL, OTHER = 1, 2, 3


@dataclass(frozen=True)
class CohortRules:
    """Item lists and limits of a case/control definition of the kind used for type 2 diabetes.

    The shape follows the publicly available eMERGE/PheKB algorithm: a case has a target code, no
    excluded code, and does not depend on the excluded drugs alone (it has none of them, or no
    target drug, or a target drug before any of them). A control has a screening lab, no abnormal
    value and no related code. ``abnormal_above`` maps a test name to the value it must exceed.
    """

    target_codes: tuple[str, ...]
    excluded_codes: tuple[str, ...]
    related_codes: tuple[str, ...]
    target_drugs: tuple[str, ...]
    excluded_drugs: tuple[str, ...]
    screening_tests: tuple[str, ...]
    abnormal_above: dict[str, float]


def _flag(condition):
    return F.max(F.coalesce(condition, F.lit(False)))


def label_cohort(medication: DataFrame, lab: DataFrame, diagnostic: DataFrame, rules: CohortRules) -> DataFrame:
    """(subject_id, label) for every patient of the three tables.

    The tables are stacked and reduced by one aggregation per patient; partial results are
    combined before the shuffle, so a patient with very many events costs one row per task.
    """
    def isin(column, items):
        return F.col(column).isin(*items) if items else F.lit(False)

    stacked = reduce(DataFrame.unionByName, [
        medication.select("subject_id", F.col("med_name").alias("med"), F.lit(None).cast("string").alias("code"),
                          F.lit(None).cast("string").alias("test"), F.lit(None).cast("double").alias("value"), "date"),
        lab.select("subject_id", F.lit(None).cast("string").alias("med"), F.lit(None).cast("string").alias("code"),
                   F.col("test_name").alias("test"), "value", "date"),
        diagnostic.select("subject_id", F.lit(None).cast("string").alias("med"), "code",
                          F.lit(None).cast("string").alias("test"), F.lit(None).cast("double").alias("value"), "date"),
    ])
    abnormal = reduce(
        lambda a, b: a | b,
        [(F.col("test") == t) & (F.col("value") > F.lit(float(limit))) for t, limit in rules.abnormal_above.items()],
        F.lit(False),
    )
    facts = stacked.groupBy("subject_id").agg(
        _flag(isin("code", rules.target_codes)).alias("target_code"),
        _flag(isin("code", rules.excluded_codes)).alias("excluded_code"),
        _flag(isin("code", rules.related_codes)).alias("related_code"),
        F.min(F.when(isin("med", rules.target_drugs), F.col("date"))).alias("first_target"),
        F.min(F.when(isin("med", rules.excluded_drugs), F.col("date"))).alias("first_excluded"),
        _flag(isin("test", rules.screening_tests)).alias("screened"),
        _flag(abnormal).alias("abnormal"),
    )
    drugs_fit = (
        F.col("first_excluded").isNull()
        | F.col("first_target").isNull()
        | (F.col("first_target") < F.col("first_excluded"))
    )
    case = F.col("target_code") & ~F.col("excluded_code") & drugs_fit
    control = F.col("screened") & ~F.col("abnormal") & ~F.col("related_code")
    return facts.select("subject_id", F.when(case, CASE).when(control, CONTROL).otherwise(OTHER).alias("label"))
