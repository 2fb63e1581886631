from pyspark.sql import functions as F

from lodeworks.functions import parsing
from lodeworks.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson")


def test_a_staff_record_is_parsed_once(spark):
    assert parses(QUERIES["staff_projection"](spark, SF)) == 1


def test_kinds_and_items_of_odd_bodies(spark):
    rows = [('[{"a":1},2]',), ('{"a":1}',), ('"x"',), ("3",), ("null",), ("{",), (None,), ("[]",)]
    df = spark.createDataFrame(rows, "b string").select(parsing.json_kind(F.col("b")).alias("k"), parsing.items_of(F.col("b")).alias("i"), parsing.items_of(F.col("b"), dicts=False).alias("n"))
    got = [tuple(r) for r in df.collect()]
    none = []
    assert got == [("list", ['{"a":1}', "2"], ['{"a":1}', "2"]), ("dict", ['{"a":1}'], none), ("str", none, none), ("other", none, none), ("other", none, none), (None, none, none), (None, none, none), ("list", none, none)]
