"""Whom replies speak to: the hand cases of the rule, and the stream against the table over many cuts and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threadloom import registry_structure
from threadloom.streaming import events, threads

START = dt.datetime(2025, 12, 11, 10)


def table(spark, rows):
    """(id, handle, minute, text, root) of one thread."""
    return spark.createDataFrame([("t", i, h, START + dt.timedelta(minutes=m), x, root) for i, h, m, x, root in rows], "thread string, id string, handle string, at timestamp, text string, root boolean")


@pytest.mark.parametrize(
    "replies, want",
    [
        ([("r1", "bob", 1, "plain"), ("r2", "carol", 2, "@bob no, that is wrong")], {"r1": "t1", "r2": "r1"}),
        ([("r1", "bob", 1, "plain"), ("r2", "carol", 2, "@nobody hello")], {"r1": "t1", "r2": "t1"}),
        ([("r1", "bob", 1, "plain"), ("r2", "carol", 2, "​@BOB agreed")], {"r1": "t1", "r2": "r1"}),
        ([("r1", "bob", 1, "a"), ("r2", "bob", 2, "b"), ("r3", "carol", 3, "@bob why")], {"r1": "t1", "r2": "t1", "r3": "r2"}),
        ([("r2", "carol", 2, "@bob ok"), ("r1", "bob", 1, "plain")], {"r1": "t1", "r2": "r1"}),
        ([("r1", "élise.x", 1, "plain"), ("r2", "carol", 2, " \u00a0@Élise.x. no"), ("r3", "bob", 3, "to @élise.x")], {"r1": "t1", "r2": "r1", "r3": "t1"}),
        ([("r1", "bob", 1, "@bob self"), ("r2", "bob", 1, "@alice hi"), ("r3", "bob", 0, "@bob no")], {"r1": "r3", "r2": "t1", "r3": "t1"}),
    ],
)
def test_hand_cases(spark, replies, want):
    rows = table(spark, [("t1", "alice", 0, "@bob top", True), *[(*r, False) for r in replies]])
    got = threads.resolved(rows, "thread", "handle", threads.named_handle(F.col("text")), "at", "id", F.col("root")).collect()
    assert {r.id: r.target for r in got} == want
    assert all((r.resolution == "handle_match") >= (r.target != "t1") for r in got)


def test_answers_wait_for_the_watermark():
    posts, asked = [(5, "a"), (1, "b"), (9, "c")], [(6, "q"), (9, "b"), (20, "z"), (0, "n")]
    assert threads.answer(posts, asked, 10) == ([("n", None), ("q", "a"), ("b", "a")], [(20, "z")], [(9, "c")])
    assert threads.answer(posts, asked, 0) == ([], asked, [(1, "b"), (5, "a"), (9, "c")])


@pytest.mark.parametrize("cut, quiet", [(40, None), (7, None), (7, 3_600_000)])
def test_stream_equals_table_over_cuts_and_a_restart(spark, tmp_path, cut, quiet):
    r = random.Random(cut)
    rows = [(f"t{r.randrange(3)}", k, r.choice("abc"), START + dt.timedelta(seconds=30 * (k // 2)), r.choice([None, "a", "b", "zz"])) for k in range(240)]
    schema = "thread string, id long, handle string, at timestamp, named string"
    came = sorted(rows, key=lambda x: (x[3], x[1]))
    for k in range(0, len(came) - 4, 5):  # rows come out of order, by less than the watermark's delay
        own = came[k : k + 5]
        r.shuffle(own)
        came[k : k + 5] = own
    parts = [came[k : k + cut] for k in range(0, len(came), cut)]

    def put(some):
        for i, part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/rows.parquet{i:03d}"))
            source = next((tmp_path / f"in/rows.parquet{i:03d}").glob("*.parquet"))
            (tmp_path / "files").mkdir(exist_ok=True)
            source.rename(tmp_path / f"files/{i:03d}.parquet")

    def run():
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "files"))
        return events.drain(threads.last_of_handle_stream(stream, "thread", "handle", F.col("named"), "at", "id", "5 minutes", quiet), str(tmp_path / "out"), str(tmp_path / "state")).collect()

    numbered = list(enumerate(parts))
    put(numbered[: len(numbered) // 2])
    early = run()
    put(numbered[len(numbered) // 2 :])
    got = run()
    want = {x.id: x.target for x in threads.last_of_handle(spark.createDataFrame(rows, schema), "thread", "handle", F.col("named"), "at", "id").collect()}
    passed = max(x[3] for x in rows) - dt.timedelta(minutes=5)
    due = {x[1] for x in rows if x[4] and x[3] < passed}
    assert len(early) < len(got) == len(due) and {x.id: x.target for x in got} == {i: want[i] for i in due}


def test_only_views_are_kept_as_posts(spark, monkeypatch):
    monkeypatch.setattr(registry_structure, "_event_stream", lambda spark, d: spark.read.parquet(f"{d}/events.parquet"))
    monkeypatch.setattr(registry_structure, "_drained", lambda spark, shape, mode: shape)
    monkeypatch.setattr(threads, "last_of_handle_stream", lambda rows, thread, handle, named, at, ident, late: threads._sides(rows, thread, handle, named, at, ident))
    events_of = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("event_type").count().collect()
    many = {r["event_type"]: r["count"] for r in events_of}
    got = registry_structure.stream_last_view_before(spark, "/root/testdata/sf0.001").groupBy("who", "post").count().collect()
    assert {(r["who"], r["post"]): r["count"] for r in got} == {("view", 1): many["view"], ("view", 0): many["purchase"]}
