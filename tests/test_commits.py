"""Snapshots on disk: commits over several tables, counters of an export, streams with child rows."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions import features
from pairloom.sources import manifest, snapshot
from pairloom.sources.snapshot import ExportHooks, Snapshot
from pairloom.streaming.ingest import append_records, ingest_records

FUNCTIONS = "id long, name string, address string, nodes int, instructions int, bytes_hash string"


def small(spark, *ids):
    functions = spark.createDataFrame([(k, f"f{k}", str(100 + k), 1, 1, "h") for k in ids], FUNCTIONS)
    return Snapshot({"functions": functions, "constants": spark.createDataFrame([(k, f"c{k}") for k in ids], "func_id long, constant string")})


def stored(spark, folder):
    s = snapshot.load(spark, folder, "functions", "constants")
    return sorted((r.id, r.address, r.constant) for r in s.functions.join(s.constants, F.col("id") == F.col("func_id"), "left").collect())


def test_an_append_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    small(spark, 1, 2).save(folder)
    before, plain = stored(spark, folder), manifest.stage

    def failing(df, folder, name):
        if name == "functions":
            raise OSError("lost")
        return plain(df, folder, name)

    for broken in ({"stage": failing}, {"commit": lambda *x, **y: (_ for _ in ()).throw(OSError("lost"))}):
        with monkeypatch.context() as m, pytest.raises(OSError):
            for k, f in broken.items():
                m.setattr(manifest, k, f)
            small(spark, 2, 3).append(folder)
        assert stored(spark, folder) == before
    (tmp_path / "manifests/000000000001/_temporary").mkdir(parents=True)  # a commit that broke off
    assert small(spark, 2, 3).append(folder) == 1
    assert stored(spark, folder) == [(1, "101", "c1"), (2, "102", "c2"), (3, "103", "c3")]


def test_a_batch_counts_once_and_ids_are_not_given_out_again(spark, tmp_path):
    folder = str(tmp_path)
    small(spark, 5).save(folder)
    assert small(spark, 7, 8).append(folder, "b1") == 2
    assert small(spark, 9).append(folder, "b1") == 0
    assert small(spark, 9).append(folder, "b2") == 1
    assert stored(spark, folder) == [(5, "105", "c5"), (6, "107", "c7"), (7, "108", "c8"), (8, "109", "c9")]
    snapshot.replace_program_data(spark, folder, {"processor": "x"})
    snapshot.replace_program_data(spark, folder, {"processor": "y"})
    assert snapshot.load(spark, folder).program == {"processor": "y"}
    small(spark, 1).save(folder)
    assert stored(spark, folder) == [(1, "101", "c1")]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    folder = str(tmp_path)
    small(spark, 1).save(folder)
    begun = manifest.state(spark, folder)
    small(spark, 2).append(folder)
    with pytest.raises(manifest.CommitError):
        manifest.commit(spark, folder, begun, {}, 0)


def test_plain_tables_are_read_and_taken_over(spark, tmp_path):
    folder = str(tmp_path)
    for name, df in small(spark, 1, 4).frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    assert len(stored(spark, folder)) == 2
    assert small(spark, 4, 5).append(folder) == 1
    assert stored(spark, folder) == [(1, "101", "c1"), (4, "104", "c4"), (5, "105", "c5")]
    with pytest.raises(snapshot.SnapshotError):
        small(spark, 1).append(str(tmp_path / "none"))


def test_an_export_counts_what_it_leaves_out(spark, tmp_path):
    s = small(spark, *range(1, 11))
    s.frames["functions"] = s.functions.withColumns({"size": F.col("id") * 2, "is_library": F.col("id") == 9, "is_thunk": F.col("id") == 8})
    number = F.col("address").cast("long")
    reason = F.when(number > 109, "outside-range").otherwise(features.skip_reason(ignore_small=True))
    s.save(str(tmp_path), ExportHooks(keep=F.col("id") != 7, reason=reason))
    found = snapshot.load(spark, str(tmp_path), "functions", "constants")
    assert sorted(r.id for r in found.functions.collect()) == [4, 5, 6]
    assert sorted(r.func_id for r in found.constants.collect()) == [4, 5, 6]
    counts = {"total_functions": "10", "exported_functions": "3", "skipped_functions": "7", "skip_reason.outside-range": "1", "skip_reason.library": "1", "skip_reason.thunk": "1", "skip_reason.small-function": "3", "skip_reason.left-out": "1"}
    assert found.program == {f"export.{k}": v for k, v in counts.items()}
    assert snapshot.export_metadata(s.functions.limit(0), F.lit("")).count() == 3


def test_a_stream_brings_child_rows(spark, tmp_path):
    schema = "name string, address string, nodes int, instructions int, bytes_hash string, constants array<struct<constant:string>>"
    rows = lambda *ks: spark.createDataFrame([(f"f{k}", str(100 + k), 1, 1, "h", [(f"c{k}",)] if k % 2 else None) for k in ks], schema)
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    for ks in ((1, 2), (2, 3)):
        rows(*ks).write.mode("append").parquet(source)
        ingest_records(spark.readStream.schema(schema).parquet(source), folder, str(tmp_path / "cp"), ("constants",)).awaitTermination()
    assert stored(spark, folder) == [(1, "101", "c1"), (2, "102", None), (3, "103", "c3")]
    append_records(folder, ("constants",))(rows(4), 1)  # the number of a batch that was taken in
    assert len(stored(spark, folder)) == 3


def test_a_snapshot_says_what_it_is(spark, tmp_path):
    folder = str(tmp_path)
    s = small(spark, 1, 2, 3)
    s.frames["functions"] = s.functions.withColumn("primes_value", F.when(F.col("id") < 3, "5").otherwise("7"))
    s.frames["callgraph"] = spark.createDataFrame([(1, "102", "call near", 0)], "func_id long, address string, type string, ordinal int")
    s.program = {"processor": "x", "md5sum": "y"}
    s.save(folder)
    found = snapshot.load(spark, folder, "functions", "version", "program", "callgraph_factors")
    assert [tuple(r) for r in found.frames["program"].collect()] == [(1, "x", "y")]
    assert {tuple(r) for r in found.callgraph_factors.collect()} == {(5, 2, 2), (7, 1, 0)}
    begun = manifest.state(spark, folder)
    other = manifest.stage(spark.createDataFrame([("0",)], "value string"), folder, "version")
    manifest.commit(spark, folder, begun, {"version": other}, begun.top, whole=("version",))
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, folder)
