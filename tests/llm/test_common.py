import pyarrow as pa
from pyspark.sql import functions as F

from sparkwarden.llm.common import STEP, step


def test_steps_hand_small_batches_to_python(spark):
    """An executor and a worker for each of its tasks hold a whole batch of texts, so batches must be small."""
    before = {key: spark.conf.get(key, None) for key in STEP}

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["id"])

    got = step(spark.range(0, 5000, 1, 1).mapInArrow(rows, "id bigint"), "batches").agg(F.max("id"), F.sum("id")).first()
    assert got[0] <= 1000 and got[1] == 5000
    assert {key: spark.conf.get(key, None) for key in STEP} == before
