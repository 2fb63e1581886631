from lodeworks.operators.shared import BATCH
from lodeworks.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_encoding_gets_bounded_batches(spark):
    for key in BATCH:
        spark.conf.unset(key)
    assert QUERIES["encode_documents"](spark, SF).count() > 0
    assert {k: spark.conf.get(k) for k in BATCH} == BATCH
