import random

from pyspark.sql import functions as F

from sparkwarden.functions.rounding import fixed, round_exact


def test_as_python(spark):
    random.seed(3)
    xs = [random.random() * random.choice([1, 10, 100, 5000]) for _ in range(3000)]
    xs += [k / 20 for k in range(1, 2500)] + [k / 200 for k in range(2, 2500)] + [a / b for a in range(1, 40) for b in range(1, 40)]
    d = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for r in d.select("x", *[fixed(F.col("x"), i).alias(f"f{i}") for i in (0, 1, 2)], round_exact(F.col("x"), 1).alias("r")).collect():
        assert (r.f0, r.f1, r.f2, r.r) == ("%.0f" % r.x, "%.1f" % r.x, "%.2f" % r.x, round(r.x, 1))
