"""Conversation repair against a search over all edits."""

import random

import brute_repair
import pytest
from edge_cases import key, sorted_rows
from pyspark.sql import functions as F

from cohortpulse.llm import conversations as c

COLUMNS = "conv_id long, turn long, role string, text string, part string, codes string"


def made(n, seed, texts=("Hi.", "So", "Yes!", "What?", "", " \t", "No.", "Go on", "A.", "B.", "C", "D!")):
    random.seed(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(random.choice([0, 1, 2, 5, 9, 30])):
            text = random.choice([*texts, None, f"{turn} says {random.random()}."])
            rows.append((conv, random.choice([turn, turn, turn + 2, None]), random.choice(roles), text))
    return rows


def in_order(rows):
    """Rows of one conversation and turn have one order, that of the table."""
    return [(*r, "x", None) for r in rows]


def stored_rows(spark, path, rows):
    spark.createDataFrame(in_order(rows), COLUMNS).coalesce(1).write.parquet(str(path))
    return c.with_rows(spark.read.parquet(str(path)))


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repair(spark, tmp_path, chunk):
    rows = made(60, 4)
    given = stored_rows(spark, tmp_path / "c", rows)
    want = brute_repair.repair(brute_repair.damage(rows), [r[0] for r in rows])
    got = sorted_rows(c.repair(c.damaged(given), given, chunk))
    assert got == sorted(want, key=key)
    assert any("R" in r[7] for r in got) and any("I" in r[7] for r in got) and any(r[5] == 0 for r in got)


def test_one_long_conversation_over_all_partitions(spark, tmp_path):
    random.seed(2)
    rows = [(7, t, random.choice(["user", "assistant"]), random.choice(["a.", f"b{t % 90}.", f"c{t}", f"d{t}."])) for t in range(900)]
    rows += [(8, 1, "user", "a."), (8, 2, "assistant", "b.")]
    given = stored_rows(spark, tmp_path / "c", rows)
    want = brute_repair.repair(brute_repair.damage(rows), [7, 8])
    for chunk in (16, 4096):
        assert sorted_rows(c.repair(c.damaged(given), given, chunk)) == sorted(want, key=key)


def test_every_turn_alike_or_blank(spark, tmp_path):
    """Vectors that no row changes pass through several chunks."""
    rows = [(1, t, "user", "same.") for t in range(40)] + [(2, t, "tool", " ") for t in range(40)] + [(3, t, "system", f"{t}") for t in range(40)]
    given = stored_rows(spark, tmp_path / "c", rows)
    want = brute_repair.repair(rows, [1, 2, 3])
    assert sorted_rows(c.repair(given.select("conv_id", "turn", "role", "text", c.ROW), given, 4)) == sorted(want, key=key)


def test_fix_up_gives_what_a_whole_run_gives():
    random.seed(5)
    for _ in range(300):
        codes = bytes(random.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(random.randrange(12)))
        new = c.vectors(bytes(random.randrange(10) for _ in range(3)), c.END)[0][0]
        after, total = c.vectors(codes, c.END)
        assert c.fix_up(codes, c.END, new, after[0], total) == (lambda v: (v[0][0], v[1]))(c.vectors(codes, new))


def test_nothing(spark, tmp_path):
    given = stored_rows(spark, tmp_path / "c", [])
    assert c.repair(c.damaged(given), given).count() == 0


def test_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_repair.repair(brute_repair.damage(rows), [r[0] for r in rows])
    assert sorted_rows(c.op13_conversations(spark, folder)) == sorted(want, key=key)
