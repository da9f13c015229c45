"""Person and household survey tables seen through the driver tables.

The expressions are ANSI SQL that Spark and the checking engine read alike. The
driver tables hold no nulls, so missing codes are derived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _yn(k: str) -> str:
    """A yes / no / unknown code: 1, 2, 2, 9 or missing."""
    return f"CASE ({k}) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 9 END"


def _amount(stated: str, zero: str) -> str:
    return f"CASE WHEN {stated} THEN CASE WHEN {zero} THEN 0.0e0 ELSE l_extendedprice END END"


PERSON_COLUMNS = {
    "id": "l_orderkey",
    "Orden": "l_linenumber",
    "Clase": "CAST(1 + l_orderkey % 2 AS INT)",
    "P6020": "CAST(1 + l_partkey % 2 AS INT)",
    "P6040": "CAST(l_quantity * 2 AS INT)",
    "P6050": "CAST(1 + l_partkey % 9 AS INT)",
    "P6090": "CASE l_suppkey % 10 WHEN 0 THEN 9 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE 1 END",
    "P6210": "CAST(CASE WHEN l_partkey % 7 = 6 THEN 9 ELSE 1 + l_partkey % 7 END AS INT)",
    "P6920": "CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END",
    "Pet": "CASE WHEN l_quantity >= 6 THEN 1 END",
    "Oc": "CASE WHEN l_quantity >= 6 AND l_returnflag = 'A' THEN 1 END",
    "Des": "CASE WHEN l_quantity >= 6 AND l_returnflag = 'R' THEN 1 END",
    "Ina": "CASE WHEN l_quantity >= 6 AND l_returnflag = 'N' THEN 1 END",
    "P6510": _yn("l_partkey + 2 * l_linenumber"),
    "P6545": _yn("l_partkey + l_suppkey"),
    "P6580": _yn("l_partkey + 2 * l_suppkey"),
    "P6585s1": _yn("l_partkey + l_linenumber + 1"),
    "P6585s2": _yn("l_partkey + 2 * l_linenumber + 2"),
    "P6585s3": _yn("l_suppkey + 3 * l_linenumber + 3"),
    "P6585s4": _yn("l_suppkey + 4 * l_linenumber + 4"),
    "P6510s1": _amount("l_tax > 0.01", "l_discount = 0"),
    "P6545s1": _amount("l_discount > 0", "l_tax = 0"),
    "P6580s1": _amount("l_tax > 0.02", "l_discount = 0"),
    "P6585s1a1": _amount("l_discount > 0.01", "l_tax = 0.01"),
    "P6585s2a1": _amount("l_discount > 0.02", "l_tax = 0.02"),
    "P6585s3a1": _amount("l_discount > 0.03", "l_tax = 0.03"),
    "P6585s4a1": _amount("l_discount > 0.04", "l_tax = 0.04"),
    "P7495": _yn("l_partkey"),
    "P7500s2": _yn("l_partkey + 3 * l_linenumber"),
    "P7500s3": _yn("l_suppkey + 2 * l_linenumber"),
    "P7505": _yn("l_partkey + l_linenumber"),
    "P7510s1": _yn("l_suppkey + l_linenumber"),
    "P7510s2": _yn("l_partkey + 2 * l_suppkey + 1"),
    "P7510s3": _yn("2 * l_partkey + l_suppkey"),
    "P7510s5": _yn("l_partkey + 3 * l_suppkey"),
    "P7510s6": _yn("l_suppkey"),
    "P7510s7": _yn("3 * l_partkey + l_linenumber"),
    "train": "CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END",
}

HOUSEHOLD_COLUMNS = {
    "id": "o_orderkey",
    "Dominio": "n_name",
    "Depto": "r_name",
    "P5090": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
    "Clase": "CAST(1 + o_orderkey % 2 AS INT)",
    "P5000": "CAST(1 + o_custkey % 6 AS INT)",
    "P5130": "o_totalprice / 1000",
    "P5140": "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 500 END",
    "Nper": "CAST(1 + o_orderkey % 7 + o_custkey % 3 AS INT)",
    "Npersug": "CAST(1 + o_orderkey % 7 AS INT)",
    "Ingpcug": "CASE WHEN o_orderkey % 97 = 0 THEN 0.0e0 ELSE o_totalprice / (1 + o_orderkey % 7) END",
    "Li": "CAST(20000 + 500 * r_regionkey AS DOUBLE)",
    "Lp": "CAST(40000 + 1000 * r_regionkey AS DOUBLE)",
    "Fex_c": "CAST(1 + o_custkey % 11 AS DOUBLE)",
    "Fex_dpto": "CAST(1 + o_custkey % 13 AS DOUBLE)",
    "train": "CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END",
}

HOUSEHOLD_JOIN = (
    "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"
)

CAPITAL = "NATION_0"
INCOME_COLUMNS = ("Ingpcug", "Pobre")


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM " + source


def view_sql(*names: str) -> str:
    """``WITH`` prefix for the checking engine; it may name ``personas`` and ``hogares``."""
    bodies = {
        "personas": _select(PERSON_COLUMNS, "lineitem"),
        "hogares": "SELECT *, CASE WHEN Ingpcug < Lp THEN 1 ELSE 0 END AS Pobre FROM ("
        + _select(HOUSEHOLD_COLUMNS, HOUSEHOLD_JOIN)
        + ")",
    }
    return "WITH " + ", ".join(f"{n} AS ({bodies[n]})" for n in names) + " "


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person; ``train`` says which file it came from."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    return lineitem.selectExpr(*[f"{e} AS {n}" for n, e in PERSON_COLUMNS.items()])


def hogares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per household with its income, poverty line and label."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    places = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("c_custkey", "n_name", "r_name", "r_regionkey")
    )
    joined = orders.join(places, orders.o_custkey == places.c_custkey)
    table = joined.selectExpr(*[f"{e} AS {n}" for n, e in HOUSEHOLD_COLUMNS.items()])
    return table.selectExpr("*", "CASE WHEN Ingpcug < Lp THEN 1 ELSE 0 END AS Pobre")


def train_part(df: DataFrame) -> DataFrame:
    return df.filter("train = 1").drop("train")


def test_part(df: DataFrame) -> DataFrame:
    """Test rows do not carry income or label, as in the survey's test files."""
    return df.filter("train = 0").drop("train", *INCOME_COLUMNS)
