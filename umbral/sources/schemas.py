"""Explicit schemas of the survey's CSV files."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the survey files.
PERSON_CODES = (
    "Clase P6020 P6040 P6050 P6090 P6100 P6210 P6210s1 P6240 Oficio P6426 P6430 P6510 P6545 P6580 "
    "P6585s1 P6585s2 P6585s3 P6585s4 P6590 P6920 P7495 P7500s2 P7500s3 P7505 P7510s1 P7510s2 P7510s3 "
    "P7510s5 P7510s6 P7510s7 Pet Oc Des Ina"
).split()
PERSON_AMOUNTS = (
    "P6510s1 P6545s1 P6580s1 P6585s1a1 P6585s2a1 P6585s3a1 P6585s4a1 Estrato1 Impa Isa Ie Imdi Iof1 Iof2 "
    "Iof3h Iof3i Iof6 Cclasnr2 Cclasnr3 Cclasnr4 Cclasnr5 Cclasnr6"
).split()
HOUSEHOLD_CODES = "Clase P5000 P5090 Nper Npersug Pobre".split()
HOUSEHOLD_AMOUNTS = "P5130 P5140 Ingpcug Li Lp Fex_c Fex_dpto".split()


def _struct(keys: list[T.StructField], codes: list[str], amounts: list[str], texts: list[str] = ()) -> T.StructType:
    return T.StructType(
        keys
        + [T.StructField(c, T.IntegerType()) for c in codes]
        + [T.StructField(c, T.DoubleType()) for c in amounts]
        + [T.StructField(c, T.StringType()) for c in texts]
    )


PERSONS = _struct(
    [T.StructField("id", T.StringType()), T.StructField("Orden", T.IntegerType())], PERSON_CODES, PERSON_AMOUNTS
)
HOUSEHOLDS = _struct([T.StructField("id", T.StringType())], HOUSEHOLD_CODES, HOUSEHOLD_AMOUNTS, ["Dominio", "Depto"])
TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType())])
SUBMISSION = T.StructType([T.StructField("id", T.StringType()), T.StructField("pobre", T.IntegerType())])
