import os
import re
from types import SimpleNamespace

import pytest
from results import executed_plan, rows
from pyspark.sql import functions as F

from cohortpulse import schemas as S
from cohortpulse.plans.queries import REGISTRY
from cohortpulse.session import shared_folder
from cohortpulse.sources import readers as R
from cohortpulse.sources import sinks as W
from cohortpulse.sources import stand_ins


def test_schemas():
    assert len(S.TABLES) == 7 and len(S.FOREIGN_KEYS) == 10 and len(S.PRIMARY_KEYS) == 4
    for key in S.FOREIGN_KEYS:
        assert key.child in S.TABLES and set(key.columns) <= set(S.TABLES[key.parent].names)
    assert S.length_limits(S.STUDENT_INFO)["imd_band"] == 16


def test_csv_by_header_name(spark, tmp_path):
    (tmp_path / "vle.csv").write_text(
        "sum_click,extra,id_site,date,code_presentation,code_module,id_student\n"
        "3,x,546,-10,2013J,AAA,28400\n"
        "1,x,547,?,2013J,AAA,28400\n"
    )
    got = R.read_base_csv(spark, str(tmp_path / "vle.csv"), "studentVle")
    assert got.schema.names == S.STUDENT_VLE.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in S.STUDENT_VLE]
    assert got.collect()[0] == (546, 28400, "AAA", "2013J", -10, 3)
    assert got.collect()[1].click_date is None


def test_csv_errors(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    (tmp_path / "c.csv").write_text("code_module,code_presentation,module_presentation_length\nAAA,2013J,long\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.read_base_csv(spark, path, "courses").collect()
    assert R.read_base_csv(spark, path, "courses", strict=False).first()[2] is None
    with pytest.raises(ValueError, match="id_site"):
        R.read_base_csv(spark, path, "vle")


def test_read_table_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert rows(R.read_parquet(spark, str(tmp_path) + "/", "t")) == [(1, "a")]
    df.createOrReplaceTempView("some_table")
    assert rows(R.read_table(spark, "some_table")) == [(1, "a")]


def test_sink_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 < 3, F.col("id") % 4).cast("int").alias("pres_groups"))
    W.write_features(df, path)
    written = spark.read.schema(df.schema).parquet(path)
    assert rows(written) == rows(df)
    pruned = written.where("pres_groups = 2")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pres_groups" in plan
    assert pruned.count() == 250
    W.write_features(df.limit(10), path)
    assert spark.read.parquet(path).count() == 10


def test_shared_folder_without_the_setting(tmp_path):
    made = []
    context = SimpleNamespace(
        getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append, master="local[2]"
    )
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    assert shared_folder(session) == shared_folder(session) == made[0] and len(made) == 1


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_csv_files_that_disagree(spark, tmp_path):
    def folder(name, **files):
        (tmp_path / name).mkdir()
        for file, text in files.items():
            (tmp_path / name / f"{file}.csv").write_text(text)
        return str(tmp_path / name)

    head = "code_module,code_presentation,module_presentation_length"
    turned = "code_presentation,code_module,module_presentation_length"
    one, two = folder("one", a=f"{head}\nAAA,2013J,10\n"), folder("two", a=f"{turned}\n2014J,BBB,20\n")
    assert rows(R.read_base_csv(spark, [one, two], "courses")) == [("AAA", "2013J", 10), ("BBB", "2014J", 20)]
    mixed = folder("mixed", a=f"{head}\nAAA,2013J,10\n", b=f"{turned}\n2014J,BBB,20\n")
    assert rows(R.read_base_csv(spark, mixed, "courses")) == [("AAA", "2013J", 10), ("BBB", "2014J", 20)]
    with pytest.raises(Exception):
        R.read_base_csv(spark, mixed, "courses", one_header=True).collect()
    for path in (folder("short", a=f"{head},x\nAAA,2013J\n"), folder("long", a=f"{head}\nAAA,2013J,10,7\n")):
        with pytest.raises(Exception):
            R.read_base_csv(spark, path, "courses").collect()


def test_three_headers_in_one_folder(spark, tmp_path):
    """Other orders, names and extra columns, blank first lines, spaces in names."""
    texts = {
        "a b": "code_module,code_presentation,module_presentation_length\r\nAAA,2013J,10\r\n",
        "c": "\n\nmodule_presentation_length,extra,code_module,code_presentation\n20,x,BBB,2014J\n",
        "d": "code_presentation,length,code_module\n2014B,30,CCC\n" + "2014J,31,CCC\n" * 2,
        "e": "code_presentation,length,code_module\n2013B,?,DDD\n",
        "none": "",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    schema, renames = R.TABLES["courses"], {"length": "module_presentation_length"}
    got = R.read_csv(spark, str(tmp_path), schema, renames, "?")
    assert [f.dataType for f in got.schema] == [f.dataType for f in schema]
    want = [("AAA", "2013J", 10), ("BBB", "2014J", 20), ("CCC", "2014B", 30), ("CCC", "2014J", 31), ("CCC", "2014J", 31), ("DDD", "2013B", None)]
    assert sorted(rows(got), key=str) == sorted(want, key=str)
    assert sorted(map(len, R.files_by_header(spark, str(tmp_path)).values())) == [1, 1, 2]
    (tmp_path / "f.csv").write_text("code_presentation,code_module\n2013B,EEE\n")
    with pytest.raises(ValueError, match="lacks"):
        R.read_csv(spark, str(tmp_path), schema, renames, "?")
    (tmp_path / "f.csv").write_text("code_presentation,length,code_module,more\n2013B,1,EEE\n")
    with pytest.raises(Exception):  # a ragged row
        R.read_csv(spark, str(tmp_path), schema, renames, "?").collect()


def test_temporary_tables_go(spark):
    with W.temporary_table(spark.range(5), "gone") as table:
        path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert table.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.createDataFrame([(1, "a.b")], "k int, `a.b` string")
    assert W.write_and_read(df, "x").columns == ["k", "a.b"]


@pytest.mark.parametrize("query", ["clicks_by_type_maps", "clicks_by_type_sparse"])
def test_many_clicks_are_joined_in_bounded_tasks(spark, monkeypatch, query):
    """More tasks than the session's partitions if the clicks ask for it, and the same rows."""
    folder = "/root/testdata/sf0.001"
    want = REGISTRY[query](spark, folder)
    n = want.sparkSession.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(stand_ins, "MANY_CLICKS", n - 1)
    monkeypatch.setattr(stand_ins, "CLICKS_A_TASK", n // 11)
    got = REGISTRY[query](spark, folder)
    plan = executed_plan(got)
    for key in ("l_orderkey", "o_orderkey"):
        assert re.search(rf"hashpartitioning\({key}#\d+L, 12\)", plan)
    order = want.columns[:4]
    assert rows(got, *order) == rows(want, *order)
