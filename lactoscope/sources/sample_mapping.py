"""Test-day and herd tables made from an order-line star schema.

The stars have no dairy data, so yields follow a known curve plus noise: level
60 + 8 * (order key mod 5), b = 20, c = -1, d = 0.0012. The same text runs on any
engine with standard date arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_DAY_SQL = """
select 1 as SourceCode, cast(c_nationkey % 5 as int) as SourceHerdID,
  o_custkey as SourceAnimalID, cast(o_custkey as string) as EarTag,
  cast(1 + o_orderkey % 5 as int) as LactationNumber,
  date '2015-01-01' + cast(o_custkey % 700 as int) as BirthDate,
  date '2020-01-01' + cast((o_orderkey % 5) * 200 - (c_nationkey % 5) * 90 as int) as FreshDate,
  cast(date_trunc('month', date '2020-01-01'
       + cast((o_orderkey % 5) * 200 - (c_nationkey % 5) * 90 + k as int)) as timestamp) as EventDateTime,
  k as DIM,
  case when l_partkey % 29 = 0 then null
       else (60e0 + 8e0 * (o_orderkey % 5)) * (1e0 - exp((-1e0 - k) / 20e0) / 2e0) * exp(-0.0012e0 * k)
            + (l_quantity - 25.5e0) * 0.2e0 end as MilkWeight,
  case when l_suppkey % 7 = 0 then null else 2.5e0 + l_discount * 20e0 end as PercentFat,
  case when l_suppkey % 11 = 0 then null else 2.6e0 + l_tax * 10e0 end as PercentProtein
from (select *, cast((l_partkey * 7 + l_linenumber * 53 + l_orderkey * 31) % 380 as int) as k
      from (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   min(l_quantity) l_quantity, min(l_discount) l_discount, min(l_tax) l_tax
            from {lineitem} group by l_orderkey, l_linenumber, l_partkey, l_suppkey) u) l
join {orders} on l_orderkey = o_orderkey
join {customer} on o_custkey = c_custkey
"""

HERD_SQL = """
select SourceCode, SourceHerdID, cast(max(EventDateTime) as date) as LastTestDayEventDate
from {testday} group by SourceCode, SourceHerdID
"""


# Orders meet their customers first: the lines, of which there are most, move once, by order key.
_JOINS = "join {orders} on l_orderkey = o_orderkey\njoin {customer} on o_custkey = c_custkey\n"
_OWNED_SQL = TEST_DAY_SQL.replace(_JOINS, "join {owned} on l_orderkey = o_orderkey\n")


def mapped_test_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders, customer = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders", "customer"))
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_nationkey")
    return spark.sql(_OWNED_SQL, lineitem=lineitem.repartition("l_orderkey"), owned=owned)


def mapped_herds(spark: SparkSession, test_days: DataFrame) -> DataFrame:
    return spark.sql(HERD_SQL, testday=test_days)
