import datetime

import pytest

from phenospark.operators.axis import build_axis
from phenospark.sources import csv as CSV
from phenospark.sources import tables as ST
from phenospark.sources import triplets as TX


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_becomes_a_view_named_after_its_file(spark, tmp_path):
    CSV.read_csv_table(spark, write(tmp_path / "visit_list.csv", "a,b\n1,x\n"))
    assert spark.sql("select b from visit_list").first()["b"] == "x"
    CSV.read_csv_table(spark, write(tmp_path / "t.csv", "a,b\n2,y\n"), name="other_name")
    assert spark.sql("select a from other_name").first()["a"] == "2"
    CSV.read_csv_table(spark, write(tmp_path / "2024.csv", "a,b\n3,z\n"))
    assert spark.sql("select a from `2024`").first()["a"] == "3"


def test_events_read_only_what_they_need(spark, tmp_path):
    med = write(tmp_path / "m.csv", "dose,date,med_name,subject_id\n5,2500-06-23,\"Salt, fine\",7\n")
    diag = write(tmp_path / "d.csv", "subject_id,code,date\n7,250.00,2500-06-22\n")
    m, d = CSV.read_events(spark, med, diag)
    assert m.first().asDict() == {"subject_id": 7, "med_name": "Salt, fine", "date": datetime.date(2500, 6, 23)}
    assert d.first()["code"] == "250.00"
    assert "dose" not in m._jdf.queryExecution().executedPlan().toString()


def test_missing_column_is_an_error(spark, tmp_path):
    bad = write(tmp_path / "bad.csv", "subject_id,code\n7,250\n")
    with pytest.raises(ValueError, match="date"):
        CSV.read_events(spark, write(tmp_path / "m.csv", "subject_id,med_name,date\n"), bad)


def test_candidates_are_lower_case_and_distinct(spark, tmp_path):
    path = write(tmp_path / "c.txt", "Insulin\ninsulin\n\nHeparin\n")
    assert sorted(r["item"] for r in CSV.read_candidate_set(spark, path).collect()) == ["heparin", "insulin"]


def test_dictionary_with_commas(spark, tmp_path):
    axis = build_axis(spark.createDataFrame([("b, c",), ("a",)], "k string"), "k", "k")
    path = f"{tmp_path}/dict"
    CSV.write_dictionary(axis.table, path)
    assert {r["key"]: r["idx"] for r in CSV.read_dictionary(spark, path).collect()} == {"a": 0, "b, c": 1}


def test_triplet_text(spark, tmp_path):
    entries = spark.createDataFrame([(0, 1, 2), (3, 0, 1), (3, 0, 1)], "patient long, med long, diag long")
    path = f"{tmp_path}/triplets"
    TX.write_triplets_text(entries, path, seed=4)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert "3 4 2 3" in lines
    records, sizes = TX.read_triplets_text(spark, path)
    assert sizes == {"n_records": 3, "n_patient": 4, "n_med": 2, "n_diag": 3}
    assert sorted(map(tuple, records.collect())) == [(0, 1, 2), (3, 0, 1), (3, 0, 1)]
    shifted, _ = TX.read_triplets_text(spark, path, offset=1)
    assert sorted(map(tuple, shifted.collect()))[0] == (1, 2, 3)


def test_triplet_text_that_lies_about_its_size(spark, tmp_path):
    path = write(tmp_path / "t.txt", "3 2 2 2\n0 0 0\n1 1 1\n")
    with pytest.raises(ValueError, match="3 records"):
        TX.read_triplets_text(spark, path)
    with pytest.raises(ValueError, match="header"):
        TX.read_triplets_text(spark, write(tmp_path / "n.txt", "0 0 0\n"))


def test_one_profile_reads_one_folder(spark, tmp_path):
    df = spark.createDataFrame([("med", 0, 0, 0.5), ("med", 1, 0, 0.25), ("diag", 1, 3, 1.0)], "axis string, k long, idx long, prob double")
    path = f"{tmp_path}/profiles"
    ST.write_profiles(df, path)
    one = ST.read_profiles(spark, path, "med", 1)
    assert [tuple(r) for r in one.collect()] == [("med", 1, 0, 0.25)]
    assert "PartitionFilters: [isnotnull(axis" in one._jdf.queryExecution().executedPlan().toString()
