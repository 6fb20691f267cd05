"""Build the library's inputs from the driver's TPC-H-style tables.

* billing  <- lineitem: one usage line per lineitem, supplier = project
  (supplier 0 becomes the null project), credits from discount and tax.
* carbon   <- lineitem: kilograms from the quantity.
* project_dim <- supplier ⋈ nation ⋈ region: department = region,
  branch = nation, directorate = nation plus ``suppkey % 3``.

Money is DECIMAL so that sums are exact whatever the task order; reports cast
to DOUBLE at the very end.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import schema as S

PRICE_TYPE = "decimal(12,2)"
RATE_TYPE = "decimal(4,2)"
CREDIT_TYPE = "decimal(18,4)"

# Fixed values of the fixture mapping.
NULL_PROJECT_SUPPKEY = "0"
CLASSIFICATION_BREAKS = ((3333, "UNCLASSIFIED"), (6666, "PROTECTED_A"))
TOP_CLASSIFICATION = "PROTECTED_B"
DIRECTORATES_PER_BRANCH = 3
ACRONYM_LENGTH = 3


# The columns this library reads from the driver tables.  Giving
# the schema up front skips schema discovery and fails fast on a type change.
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _project_struct() -> F.Column:
    pid = F.nullif(F.col("l_suppkey").cast("string"), F.lit(NULL_PROJECT_SUPPKEY))
    return F.struct(pid.alias("id")).alias(S.PROJECT)


def billing_from_lineitem(lineitem: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast(PRICE_TYPE)
    discount = (-(price * F.col("l_discount").cast(RATE_TYPE))).cast(CREDIT_TYPE)
    promo = (-(price * F.col("l_tax").cast(RATE_TYPE))).cast(CREDIT_TYPE)

    def credit(name, amount):
        return F.struct(F.lit(name).alias("name"), amount.alias("amount"))

    empty = F.array().cast(f"array<struct<name:string,amount:{CREDIT_TYPE}>>")
    flag = F.col("l_returnflag")
    credits = (
        F.when(flag == "A", F.array(credit("discount", discount)))
        .when(flag == "R", F.array(credit("discount", discount), credit("promo", promo)))
        .otherwise(empty)
    )
    credit_sum = (
        F.when(flag == "A", discount)
        .when(flag == "R", (discount + promo).cast(CREDIT_TYPE))
        .otherwise(F.lit(0).cast(CREDIT_TYPE))
    )
    return lineitem.select(
        F.col("l_shipdate").alias(S.USAGE_START_TIME),
        _project_struct(),
        price.alias(S.COST),
        credits.alias(S.CREDITS),
        credit_sum.alias(S.CREDITS_SUM_AMOUNT),
    )


def carbon_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_shipdate").alias(S.USAGE_START_TIME),
        _project_struct(),
        F.col("l_quantity").cast(PRICE_TYPE).alias(S.CARBON_KG),
    )


def project_dim_from_suppliers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    (lo_cut, lo_name), (mid_cut, mid_name) = CLASSIFICATION_BREAKS
    bal = F.col("s_acctbal")
    classification = F.when(bal < lo_cut, lo_name).when(bal < mid_cut, mid_name).otherwise(TOP_CLASSIFICATION)
    directorate = F.concat(F.col("n_name"), F.lit("-"), (F.col("s_suppkey") % DIRECTORATES_PER_BRANCH).cast("string"))
    directorate_acr = F.concat(
        F.upper(F.substring("n_name", 1, ACRONYM_LENGTH)), (F.col("s_suppkey") % DIRECTORATES_PER_BRANCH).cast("string")
    )
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_suppkey").cast("string").alias(S.PROJECT_ID),
            classification.alias("classification"),
            F.col("r_name").alias("department"),
            F.upper(F.substring("r_name", 1, ACRONYM_LENGTH)).alias("department_acronym"),
            F.col("n_name").alias("branch"),
            F.upper(F.substring("n_name", 1, ACRONYM_LENGTH)).alias("branch_acronym"),
            directorate.alias("directorate"),
            directorate_acr.alias("directorate_acronym"),
        )
    )


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_from_lineitem(read_table(spark, sf_dir, "lineitem"))


def carbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carbon_from_lineitem(read_table(spark, sf_dir, "lineitem"))


def project_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_dim_from_suppliers(
        read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    )


def billing_long_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The billing lines with as many credits as the line number says (1 to 7): growing
    multiples of the discount, without a precomputed sum."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast(PRICE_TYPE)
    discount = (-(price * F.col("l_discount").cast(RATE_TYPE))).cast(CREDIT_TYPE)
    credits = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.struct(
        F.concat(F.lit("credit "), i.cast("string")).alias("name"), (discount * i).cast(CREDIT_TYPE).alias("amount")))
    return lineitem.select(F.col("l_shipdate").alias(S.USAGE_START_TIME), _project_struct(), price.alias(S.COST),
                           credits.alias(S.CREDITS))


def shared_names_dim(dim: DataFrame) -> DataFrame:
    """The dimension with directorate names that several branches share."""
    number = (F.col(S.PROJECT_ID).cast("long") % DIRECTORATES_PER_BRANCH).cast("string")
    return dim.withColumn("directorate", F.concat(F.lit("DIR-"), number))


def bad_classes_dim(dim: DataFrame) -> DataFrame:
    """The dimension with classifications outside the domain, and null ones."""
    digit = F.col(S.PROJECT_ID).cast("long") % 10
    return dim.withColumn("classification", F.when(digit == 0, "SECRET").when(digit != 1, F.col("classification")))
