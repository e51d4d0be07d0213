"""Who a reply speaks to: the latest earlier writer of the named handle in its thread, else the thread's root; in a table or a stream.

The stream keeps, for every thread and handle, the posts that a question not yet answered may need: all since the watermark and the last
before it. A question waits until the watermark has passed it, as only then no earlier post can come; so any cut of the input into
batches gives the table's answers, rows that come later than the watermark allows excepted, which Spark drops. With ``quiet``, handles
that were silent for that long are forgotten.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from threadloom.functions.prepare import unicode_classes

#: Fixed value: a reply's first word names whom it speaks to.
LEADING_HANDLE = r"^[\s]*@([\w-]+(?:\.[\w-]+)*)"


def named_handle(text: Column) -> Column:
    """The handle that a text begins with, lower case; zero-width characters don't count, and without one it is null."""
    found = F.lower(F.regexp_extract(F.regexp_replace(text, "[​‌‍⁠﻿]", ""), unicode_classes(LEADING_HANDLE), 1))
    return F.when(found != "", found)


def _sides(rows: DataFrame, thread: str, handle: str, named: Column, at: str, ident: str) -> DataFrame:
    """Each row as a post of its handle and, if it names one, as a question for the named."""
    both = F.array(F.struct(F.lit(1).alias("post"), F.col(handle).alias("who")), F.struct(F.lit(0).alias("post"), named.alias("who")))
    return rows.select(F.col(thread).alias("thread"), F.col(at).alias("at"), F.col(ident).alias("id"), F.explode(both).alias("x")).select("thread", "at", "id", "x.*").where("who is not null")


def last_of_handle(rows: DataFrame, thread: str, handle: str, named: Column, at: str, ident: str) -> DataFrame:
    """``id`` and ``target`` (null if there is none) of every row that names a handle; rows are ordered by (``at``, ``ident``)."""
    w = Window.partitionBy("thread", "who").orderBy("at", "id", "post").rowsBetween(Window.unboundedPreceding, -1)
    sides = _sides(rows, thread, handle, named, at, ident).withColumn("target", F.last(F.when(F.col("post") == 1, F.col("id")), ignorenulls=True).over(w))
    return sides.where("post = 0").select("id", "target")


def resolved(rows: DataFrame, thread: str, handle: str, named: Column, at: str, ident: str, is_root: Column) -> DataFrame:
    """``rows`` other than roots with ``target`` and ``resolution``: ``handle_match``, or ``thread_root`` for those that name nobody known.

    A thread's root comes before its replies, whatever its time says.
    """
    timed = rows.select(F.struct("*").alias("row"), F.col(thread).alias("thread"), F.col(handle).alias("handle"), named.alias("named"), F.struct(F.when(is_root, 0).otherwise(1).alias("late"), F.col(at).alias("at")).alias("at"), F.col(ident).alias("id"), is_root.alias("root"))
    roots = timed.where("root").groupBy("thread").agg(F.min("id").alias("top"))
    found = last_of_handle(timed, "thread", "handle", F.when(~F.col("root"), F.col("named")), "at", "id")
    joined = timed.where("not root").join(found, "id", "left").join(roots, "thread", "left")
    return joined.select("row.*", F.coalesce("target", "top").alias("target"), F.when(F.col("target").isNotNull(), "handle_match").otherwise("thread_root").alias("resolution"))


def answer(posts: list[tuple], questions: list[tuple], watermark: float) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Answers (id, target) to the questions before the watermark, the questions left, and the posts still needed; all are (at, id)."""
    posts = sorted(posts)
    ready = sorted(q for q in questions if q[0] < watermark)
    places = [bisect_left(posts, q) for q in ready]
    settled = bisect_left(posts, (watermark,))
    return [(q[1], posts[k - 1][1] if k else None) for q, k in zip(ready, places, strict=True)], [q for q in questions if q[0] >= watermark], posts[max(0, settled - 1) :]


def last_of_handle_stream(rows: DataFrame, thread: str, handle: str, named: Column, at: str, ident: str, late: str, quiet_ms: int | None = None) -> DataFrame:
    """``last_of_handle`` of a stream, append mode: an answer comes once the watermark (``late`` behind the latest row) has passed its row."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    sides = _sides(timed, thread, handle, named, at, ident).select("thread", "who", "post", "at", F.unix_micros("at").alias("micros"), "id")
    kind = dict(sides.dtypes)["id"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        post_at, post_id, asked_at, asked_id = state.get if state.exists else ([], [], [], [])
        posts, asked = list(zip(post_at, post_id, strict=True)), list(zip(asked_at, asked_id, strict=True))
        for frame in frames:
            for is_post, when, who in zip(frame["post"].tolist(), frame["micros"].tolist(), frame["id"].tolist(), strict=True):
                (posts if is_post else asked).append((when, who))
        now = state.getCurrentWatermarkMs()
        answers, asked, posts = answer(posts, asked, now * 1000)
        last = max((p[0] for p in posts), default=None)
        if quiet_ms is not None and not asked and (last is None or last // 1000 + quiet_ms < now):
            state.remove()
        else:
            state.update(tuple([r[i] for r in side] for side in (posts, asked) for i in (0, 1)))
            wakes = [min(a[0] for a in asked) // 1000 + 1] if asked else [last // 1000 + quiet_ms + 1] if quiet_ms is not None and last is not None else []
            if wakes:
                state.setTimeoutTimestamp(max(now + 1, wakes[0]))
        if answers:
            yield pd.DataFrame(answers, columns=["id", "target"]).astype({"target": "Int64"} if kind in ("bigint", "int") else {"id": object, "target": object})

    held = f"post_at array<long>, post_id array<{kind}>, asked_at array<long>, asked_id array<{kind}>"
    return sides.groupBy("thread", "who").applyInPandasWithState(step, f"id {kind}, target {kind}", held, "append", GroupStateTimeout.EventTimeTimeout)
