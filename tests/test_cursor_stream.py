"""The table that is read as a stream by its ids: batches, restarts, rows that come later, odd tables."""

import pytest
from pyspark.sql import functions as F

from voxtide.sources.cursor_stream import CursorReader, cursor_stream
from voxtide.sources.shared import work_folder

SCHEMA = "id long, title string"


def drain(spark, path, folder, rows, fail_at=None, schema=SCHEMA):
    """The ids of each batch that ended, in a run that is broken in a batch."""
    seen: dict[int, list[int]] = {}

    def take(batch, epoch):
        if epoch == fail_at:
            raise RuntimeError("lost")
        seen[epoch] = sorted(r["id"] for r in batch.select("id").collect())

    stream = cursor_stream(spark, path, schema, f"{folder}/cursor", rows)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        query.processAllAvailable()
    except Exception:
        assert fail_at is not None
    finally:
        query.stop()
    return seen


def titled(ids):
    return ids.select("id", F.concat(F.lit("t"), "id").alias("title"), F.lit(1).alias("other"))


def test_batches_and_restart(spark):
    folder = work_folder(spark, "cursor-test")
    path = f"{folder}/voices"
    titled(spark.range(1, 1001, 1, 3)).write.parquet(path)
    first = drain(spark, path, folder, 300, fail_at=2)
    assert first == {0: list(range(1, 301)), 1: list(range(301, 601))}
    titled(spark.range(1001, 1101, 1, 2)).write.mode("append").parquet(path)
    assert drain(spark, path, folder, 200) == {2: list(range(601, 901)), 3: list(range(901, 1101))}  # what was planned stays as it was planned
    assert drain(spark, path, folder, 200) == {}
    titled(spark.range(50, 60)).union(titled(spark.range(1200, 1203))).write.mode("append").parquet(path)
    assert drain(spark, path, folder, 200) == {4: [1200, 1201, 1202]}


def test_scattered_ids_ties_nulls_and_long_texts(spark):
    folder = work_folder(spark, "cursor-test")
    ids = [*range(0, 60), *[30] * 40, None, None]
    rows = spark.createDataFrame([(i, "x" * 300_000 if i == 7 else None if i == 8 else "") for i in ids], SCHEMA)
    rows.repartition(5, F.rand(3)).write.parquet(f"{folder}/voices")
    got = drain(spark, f"{folder}/voices", folder, 25)
    assert got == {0: list(range(25)), 1: [25, 26, 27, 28, 29, *[30] * 41], 2: list(range(31, 56)), 3: list(range(56, 60))}


@pytest.mark.parametrize("rows", [[], [(None, "a")]])
def test_tables_without_ids(spark, rows):
    folder = work_folder(spark, "cursor-test")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/voices")
    assert drain(spark, f"{folder}/voices", folder, 10) in ({}, {0: []})


def test_a_batch_reads_the_groups_of_its_range(spark, tmp_path):
    path = str(tmp_path / "voices")
    titled(spark.range(0, 1000, 1, 10)).write.parquet(path)
    reader = CursorReader({"path": f"file://{path}", "cursor": f"file://{tmp_path}/cursor", "rows": "150", "start": "-1"}, None)
    assert reader.latestOffset() == {"id": 149}
    parts = reader.partitions({"id": -1}, {"id": 149})
    assert sorted((p.group.low, p.group.high) for p in parts) == [(0, 99), (100, 199)]
    assert reader.latestOffset() == {"id": 299} and len(reader.partitions({"id": 149}, {"id": 299})) == 2 and sum(map(len, reader.footers.values())) == 9
    again = CursorReader({"path": f"file://{path}", "cursor": f"file://{tmp_path}/cursor", "rows": "10"}, None)
    assert again.latestOffset() == {"id": 309}


def test_many_batches_of_one_run_are_those_of_many_runs(spark):
    """With ties at their ends, a broken run and rows that come later; in far fewer runs."""
    folder = work_folder(spark, "cursor-test")
    ids = [*range(0, 60), *[30] * 40, *range(60, 300), None]
    spark.createDataFrame([(i, "") for i in ids], SCHEMA).repartition(5, F.rand(3)).write.parquet(f"{folder}/voices")
    path, plain, runs = f"{folder}/voices", drain(spark, f"{folder}/voices", f"{folder}/plain", 25), []

    def drained(fail_at=None):
        seen: dict[int, list[int]] = {}

        def take(rows, epoch):
            runs.append(epoch)
            if epoch == fail_at:
                raise RuntimeError("lost")
            for r in rows.collect():
                seen.setdefault(r["batch"], []).append(r["id"])

        stream = cursor_stream(spark, path, SCHEMA, f"{folder}/cursor", 25, ahead=4)
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").start()
        try:
            query.processAllAvailable()
        except Exception:
            assert fail_at is not None
        finally:
            query.stop()
        return {b: sorted(x) for b, x in seen.items()}

    got = drained(fail_at=1)
    got |= drained()
    assert got == plain and len(plain) > 10 and len(set(runs)) <= 5
    titled(spark.range(400, 430)).select("id", "title").write.mode("append").parquet(path)
    last = max(got)
    assert drained() == {last + 1: list(range(400, 425)), last + 2: list(range(425, 430))}
