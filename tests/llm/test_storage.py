"""Where intermediate tables lie, and when they go."""

from types import SimpleNamespace

import pytest
from test_llm import text

from tessera.llm import _spark, lines


def _files(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(_spark.shared_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(x.getPath()) for x in fs.listStatus(path)} if fs.exists(path) else set()


def _tables(spark):
    return {t.name for t in spark.catalog.listTables() if t.name.startswith(_spark.TABLES)}


def _docs(spark):
    return spark.createDataFrame([(i, text(i % 3) + "\n" + text(i)) for i in range(20)], "doc_id long, text string")


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="checkpoint"):
        _spark.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default)))


def test_released_tables_go(spark):
    before = _files(spark), _tables(spark)
    with _spark.released(spark):
        assert lines.dedup(_docs(spark)).count() == 20
        assert _files(spark) > before[0] and _tables(spark) > before[1]
    assert (_files(spark), _tables(spark)) == before


def test_tables_stay_until_they_are_swept(spark):
    out = lines.dedup(_docs(spark))
    assert out.count() == out.count() == 20
    assert _files(spark) and _tables(spark)
    _spark.sweep(spark)
    assert not _files(spark) and not _tables(spark)


def test_released_leaves_tables_of_other_threads(spark):
    """Two pieces of work side by side: what the other one has written stays."""
    import threading

    from tessera.llm._spark import cut, released

    other = []
    with released(spark):
        own = cut(spark.range(3))
        thread = threading.Thread(target=lambda: other.append(cut(spark.range(4))))
        thread.start()
        thread.join()
        assert own.count() == 3
    assert other[0].count() == 4
    try:
        gone = own.count() == 0
    except Exception:  # noqa: BLE001
        gone = True
    assert gone
