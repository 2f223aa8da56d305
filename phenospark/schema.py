"""Column layouts of the tables that operators exchange."""

from pyspark.sql import types as T

MEDICATION_CSV = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("med_name", T.StringType()),
    T.StructField("date", T.StringType()),
])

DIAGNOSTIC_CSV = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("code", T.StringType()),
    T.StructField("date", T.StringType()),
])

DIAGNOSTIC = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("code", T.StringType()),
])

LAB_RESULT = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("test_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

MEDICATION = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("medicine", T.StringType()),
])

DICTIONARY = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("idx", T.LongType()),
])

# axis order of the tensor
AXES = ("patient", "diag", "med")
