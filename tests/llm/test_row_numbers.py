"""Decisions reach their rows though a later scan cuts files into other partitions."""

import brute
from edge_cases import edge_rows, key, sorted_rows
from pyspark.sql import functions as F

from cohortpulse.llm import common, grace, mixing, simhash, suffixes, tokens


def other_cuts(setting):
    setting(spark__sql__files__openCostInBytes="1", spark__sql__files__maxPartitionBytes="700", spark__sql__files__minPartitionNum="40")


def test_exact_dedup(edge, setting):
    left = grace.drop_exact(edge)
    other_cuts(setting)
    contents = [brute.BLANK.sub("", r.text or "") for r in left.collect()]
    assert sorted(contents) == sorted({brute.BLANK.sub("", r[1] or "") for r in edge_rows()})


def test_near_dedup(edge, setting):
    want = sorted(str(r) for r in simhash.drop_similar(edge, 4).collect())
    left = simhash.drop_similar(edge, 4)
    other_cuts(setting)
    assert sorted(str(r) for r in left.collect()) == want


def test_repeated_passages(edge, setting):
    left = suffixes.without_repeats(edge)
    other_cuts(setting)
    got = left.select("doc_id", "n_removed", "n_spans", F.sha2("remaining", 256))
    assert sorted_rows(got) == sorted(brute.repeats(edge_rows(), suffixes.SPAN), key=key)


def test_by_fingerprints(edge, setting):
    left = simhash.drop_near(edge)
    other_cuts(setting)
    codes = [simhash.fingerprint((r.text or "").encode()) for r in left.collect()]
    assert len(codes) == len({c for _, _, c in brute.near(edge_rows())})
    assert sorted(min(bin((a ^ b) & (1 << 64) - 1).count("1") for b in codes if a != b) for a in codes)[0] > 4


def test_numbers_of_parquet_rows_need_no_copy(spark, edge, tmp_path, setting):
    given = common.with_rows(edge.select("doc_id", "text"))
    assert not any("/rows-" in f for f in given.inputFiles())
    numbers = sorted(map(str, given.collect()))
    assert len({r[common.ROW] for r in given.collect()}) == len(edge_rows())
    other_cuts(setting)
    assert sorted(map(str, given.collect())) == numbers


def test_other_rows_are_written(spark, edge):
    for frame in (edge.union(edge), edge.filter("doc_id > 3"), edge.selectExpr("doc_id + 1 as doc_id", "text"), spark.range(3)):
        assert any("/rows-" in f for f in common.with_rows(frame).inputFiles())


def test_a_column_with_the_number_s_name(edge):
    given = edge.withColumn(common.ROW, F.lit("own"))
    for left in (grace.drop_exact(given), simhash.drop_near(given), simhash.drop_similar(given), mixing.mixed(given, tokens.vocabulary_path(), most_passes=1.5)):
        assert sorted(left.columns) == sorted(given.columns)
        assert {r[common.ROW] for r in left.collect()} == {"own"}
