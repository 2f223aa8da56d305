"""The sparse patient x diagnosis x medication tensor as a coordinate table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from phenospark.operators.axis import Axis, build_axis, dense_index, encode_axis
from phenospark.operators.visits import visit_pairs
from phenospark.runtime import materialize
from phenospark.schema import AXES

MULTIPLICITIES = ("bag", "binary")


@dataclass(frozen=True)
class RecordTensor:
    """Coordinates ``(patient, diag, med, value)`` and the dictionary of each axis.

    Bag tensors also carry the visit ``day``, which tells repeated coordinates apart.
    """

    entries: DataFrame
    axes: dict[str, Axis]

    @property
    def dims(self) -> dict[str, int]:
        return {name: self.axes[name].size for name in AXES}


def tensor_from_pairs(pairs: DataFrame, multiplicity: str = "bag") -> RecordTensor:
    """Index the pairs of visits. ``bag`` keeps one entry per visit, ``binary`` one per coordinate."""
    if multiplicity not in MULTIPLICITIES:
        raise ValueError(f"multiplicity must be one of {MULTIPLICITIES}")
    stored = materialize(pairs.select("subject_id", "day", "code", "med_name"), "pairs")
    axes = {
        "patient": build_axis(stored, "subject_id", "patient"),
        "diag": build_axis(stored, "code", "diag"),
        "med": build_axis(stored, "med_name", "med"),
    }
    rows = stored if multiplicity == "bag" else stored.select("subject_id", "code", "med_name").distinct()
    rows = encode_axis(rows, axes["diag"], "code", "diag")
    rows = encode_axis(rows, axes["med"], "med_name", "med")
    rows = encode_axis(rows, axes["patient"], "subject_id", "patient")
    extra = ["day"] if multiplicity == "bag" else []
    return RecordTensor(rows.select(*AXES, *extra, F.lit(1.0).alias("value")), axes)


def build_tensor(medication: DataFrame, diagnostic: DataFrame, multiplicity: str = "bag", **options) -> RecordTensor:
    """From two event tables to the tensor and its three dictionaries."""
    return tensor_from_pairs(visit_pairs(medication, diagnostic, **options), multiplicity)


def tensor_dims(entries: DataFrame) -> DataFrame:
    """One row with the size of each axis and the number of entries; the indexes are dense from 0."""
    return entries.agg(
        *[F.coalesce(F.max(a) + 1, F.lit(0)).cast("bigint").alias(f"n_{a}") for a in AXES], F.count(F.lit(1)).alias("n_entries")
    )


def number_records(tensor: RecordTensor) -> DataFrame:
    """Entries with a dense record number in coordinate order."""
    return number_entries(tensor.entries)


def number_entries(entries: DataFrame) -> DataFrame:
    """The same for a bare coordinate table, in which coordinates may repeat without a day."""
    order = [c for c in (*AXES, "day") if c in entries.columns]
    return dense_index(entries, order, "rec_id", unique="day" in order)[0]


def triplet_columns(entries: DataFrame) -> DataFrame:
    """The coordinates as columns A, B, C = patient, diagnosis, medication."""
    return entries.select(F.col("patient").alias("A"), F.col("diag").alias("B"), F.col("med").alias("C"))
