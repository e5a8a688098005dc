import random

from sparkwarden.operators.behaviour import smallest_members


def test_smallest_members(spark):
    rnd = random.Random(5)
    members, points = [], []
    for k in range(3):
        names = [f"n{i:04d}" for i in rnd.sample(range(9999), 600)]
        members += [(f"k{k}", name, i + 1) for i, name in enumerate(names)]
        points += [(f"k{k}-{n}", f"k{k}", n) for n in (1, 3, 15, 16, 17, 255, 256, 257, 300, 600)]
    got = smallest_members(spark.createDataFrame(members, "key string, member string, n bigint"),
                           spark.createDataFrame(points, "id string, key string, upto bigint")).collect()
    assert len(got) == len(points)
    for r in got:
        key, n = r.id.split("-")
        assert r.members == sorted(m for k, m, i in members if k == key and i <= int(n))[:5]
