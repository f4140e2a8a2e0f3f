import sys

import __spark_entry__
from sedgewren import session


def test_entry_without_the_training_data_queries(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sedgewren.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sedgewren.llm", None)  # importing it raises ImportError
    found = __spark_entry__.queries()
    assert "bm25_topk" in found and not any(k == "pipeline" or k.startswith("op") for k in found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_scratch_tables_go(spark):
    with session.Scratch(spark) as keep:
        one, two = keep(spark.range(3), "one"), keep(spark.range(4), "two")
        keep.drop(one)
        paths = [path for _, path in keep.paths.values()]
        assert two.count() == 4 and len(paths) == 1
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    assert not any(hadoop(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(p)) for p in paths)


def test_small_text_tables_are_dealt(spark, tmp_path):
    spark.range(9).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert session.text_table(spark, str(tmp_path), "t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
