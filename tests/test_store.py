import os
import shutil
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest

from contract.queries import QUERIES, engine
from sparkwarden.plans.store import Store, shared_folder


def test_shared_folder_on_a_cluster():
    def session(named, told=None):
        hadoop = SimpleNamespace(get=lambda _: "file:///")
        context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: told,
                                  _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=context)

    for path in ("/mnt/shared", "file:/mnt/shared", "file:///mnt/shared", "hdfs://name/shared"):
        assert shared_folder(session(path)) == path
    assert shared_folder(session(None, "file:/mnt/shared/1f")) == "file:/mnt/shared/1f"
    with pytest.raises(ValueError):
        shared_folder(session(None))


def test_queries_survive_a_cleared_shared_folder(spark, tmp_path):
    """Also when the events table is another one than before."""
    def events(n):
        spark.range(n).selectExpr("id as event_id", "id % 9 as user_id", "element_at(array('error', 'purchase', 'view', 'click'), int(id % 4) + 1) as event_type").write.mode(
            "overwrite").parquet(f"{tmp_path}/events.parquet")

    def result(name):
        return sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect()))

    def cleared():
        shutil.rmtree(engine(spark, str(tmp_path)).store.folder.removeprefix("file:"))

    names = ["classify_event", "list_log_files", "read_lines"]
    events(60)
    first = [result(x) for x in names]
    assert all(first) and engine(spark, str(tmp_path)) is engine(spark, str(tmp_path))
    for name, rows in zip(names, first, strict=True):
        cleared()
        assert result(name) == rows
    assert result("classify_event") == first[0]
    folder = f"{engine(spark, str(tmp_path)).store.folder}/scanned".removeprefix("file:")
    os.remove(next(f"{folder}/{x}" for x in os.listdir(folder) if x.startswith("part-")))
    assert result("classify_event") == first[0]
    events(80)
    assert len(result("detect_format")) == 80 and result("classify_event") != first[0]


def test_queries_at_once_write_a_table_once(spark, tmp_path):
    store, built = Store(spark, str(tmp_path)), []

    def build():
        built.append(1)
        time.sleep(1)
        return store.table("inner", lambda: spark.range(7)).selectExpr("id + 1 as id")

    with ThreadPoolExecutor(3) as pool:
        rows = list(pool.map(lambda _: store.table("outer", build).count(), range(3)))
    assert rows == [7, 7, 7] and len(built) == 1
