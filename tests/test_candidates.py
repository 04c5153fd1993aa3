"""Candidates of rules whose keys many records share."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import candidates
from pairloom.operators.rules import RULES
from pairloom.sources.snapshot import Snapshot
from pairloom.sources.testpair import pair

PAIRS = ["a_id", "b_id", "description", "order_key"]


@pytest.fixture
def dealt(monkeypatch):
    monkeypatch.setattr(candidates, "SHARE", 100)
    return lambda k, a, b: candidates.candidates(RULES[k], a, b, few=0)


@pytest.mark.parametrize("k", [11, 15, 22, 29, 32, 36, 42, 44, 48, 50])
def test_dealt_pairs_are_those_of_the_plain_join(spark, dealt, k):
    a, b = pair(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(map(tuple, df.select(*PAIRS).collect()))
    assert rows(dealt(k, a, b)) == rows(candidates.candidates(RULES[k], a, b))


def _alike(spark, n):
    """Functions of one number of loops and one graph each."""
    about = spark.range(n).select("id", F.lit(9).alias("instructions"), F.lit(4).alias("nodes"), F.lit(5).alias("edges"), F.lit(3).alias("cyclomatic_complexity"), F.lit(2).alias("loops"), F.lit("s").alias("source_file"))
    return Snapshot({"functions": about})


def test_pairs_of_one_key_come_from_several_tasks(spark, dealt):
    s = _alike(spark, 60)
    by_task = dealt(42, s, s).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 3600 and len(by_task) > 1


def test_pairs_are_not_shuffled_to_be_distinct(spark, dealt):
    """Unless a snapshot has an id twice, pairs of a rule on records alone come once by themselves."""
    s = _alike(spark, 60)
    assert "Aggregate" not in dealt(48, s, s)._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    twice = Snapshot({"functions": s.functions.union(s.functions.where("id < 3"))})
    assert dealt(48, twice, s).count() == 3600


def test_conditions_part_at_plain_ands_only():
    assert candidates._conjuncts("f.x = 1 and (f.y = 2 and df.y = 3) and df.z <> 'a and (b'") == ["f.x = 1", "(f.y = 2 and df.y = 3)", "df.z <> 'a and (b'"]
    assert candidates._conjuncts("f.x between 1 and 3") == ["f.x between 1 and 3"]


def test_dealt_pairs_are_in_an_order_that_packs(spark, tmp_path):
    """40 records beside 30,000 of one key: ids that come in one long row take about 2 bytes a pair on disk."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    candidates.candidates(RULES[42], _alike(spark, 40), _alike(spark, 30_000), few=0).write.parquet(str(tmp_path / "out"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    files = list((tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1_200_000 and sum(f.stat().st_size for f in files) < 0.6 * 1_200_000


def test_a_share_has_few_records(spark, dealt):
    """A key with one record of A and many of B is dealt over tasks as well as one with many of both."""
    by_task = dealt(42, _alike(spark, 1), _alike(spark, 600)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 600 and len(by_task) > 1


def test_what_one_side_says_is_asked_once_a_record(spark):
    assert candidates._either("(substr(f.x, 1, 4) = 'a' or df.y > 2)") == ["substr(f.x, 1, 4) = 'a'", "df.y > 2"]
    assert not candidates._either("(f.x = df.x or f.y = 1)") and not candidates._either("(f.x = 1) or (df.y = 2)")
    x, y, _, across = candidates._sides(RULES[15], *pair(spark, "/root/testdata/sf0.001"), candidates.POSTFIX)
    assert across == ["f.test_0 or df.test_1"] and x.schema["f"].dataType.names == ["test_0", "id"] and y.schema["df"].dataType.names == ["test_1", "id"]
