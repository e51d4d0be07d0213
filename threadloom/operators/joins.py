"""Joins with semantics beyond equality: windows, nearest, last-before, coverage, guarded cardinality, signatures."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Dimension rows that may be broadcast; larger calendars join by shuffled day buckets.
CALENDAR_BOUND = 10_000
#: Rows a task of a spread table, about.
ROWS_A_TASK = 500_000
#: Tokens whose votes are summed at a time.
VOTES = 100_000


def parts_of(rows: DataFrame, each: int | None = None) -> int:
    """How many tasks hold ``rows`` at about ``each`` a task; their count comes from the files' footers if ``rows`` is a plain scan."""
    return max(1, -(-rows.count() // (each or ROWS_A_TASK)))


def spread(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over ``parts`` tasks; as they are if the session's own number of shuffle partitions is no less."""
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts > own else rows


def small(dim: DataFrame, bound: int = CALENDAR_BOUND) -> DataFrame:
    """The dimension with a broadcast hint if it has at most ``bound`` rows, else as it is."""
    return F.broadcast(dim) if dim.limit(bound + 1).count() <= bound else dim


def in_window(rows: DataFrame, at: Column, windows: DataFrame, start: str = "start", end: str = "end", bound: int = CALENDAR_BOUND) -> DataFrame:
    """Rows, streaming or not, with every half-open window [start, end) that holds them. More than ``bound`` windows are spread over their
    days, so that rows meet them on an equal day."""
    inside = (at >= F.col(start)) & (at < F.col(end))
    if windows.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(windows), inside)
    days = windows.where(F.col(start) < F.col(end)).withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    return rows.join(days, (F.to_date(at) == F.col("_day")) & inside).drop("_day")


def nearest(rows: DataFrame, key: str, at: Column, calendar: DataFrame, when: str, name: str) -> DataFrame:
    """The calendar entry nearest in days to each row, ties to the earlier, and the signed offset. Of a day's entries the first alone can
    win, so the calendar shrinks to a row a day, in one array that every row scans: no join, no shuffle, and no growth with its rows."""
    firsts = calendar.groupBy(F.to_date(when).alias("_day")).agg(F.min(F.struct(F.col(when).alias("when"), F.col(name).alias("name"))).alias("first"))
    packed = firsts.agg(F.array_sort(F.collect_list("first")).alias("_cal"))
    joined = rows.crossJoin(F.broadcast(packed))  # one row
    ranked = F.array_min(F.transform("_cal", lambda c: F.struct(F.abs(F.datediff(at, c["when"])).alias("gap"), c["when"].alias("when"), c["name"].alias("name"))))
    return joined.withColumn("_n", ranked).withColumn("nearest", F.col("_n.name")).withColumn("offset_days", F.datediff(at, F.col("_n.when"))).drop("_n", "_cal")


def last_before(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` of earlier rows in the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys are on the left only, the right only, or both."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def many_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join that fails at run time if the right side repeats a key."""
    guarded = right.groupBy(key).agg(*[F.first(c).alias(c) for c in right.columns if c != key], F.count(F.lit(1)).alias("_n"))
    checked = guarded.withColumn("_ok", F.assert_true(F.col("_n") == 1, f"{key} repeats")).where(F.col("_ok").isNull())
    return left.join(checked.drop("_n", "_ok"), key, how)


def simhash_bands(rows: DataFrame, *keys: str, tokens: str) -> DataFrame:
    """``keys`` and the 64-bit SimHash of each row's tokens as four 16-bit bands; a bit is set iff its sum of votes is positive. A row's
    votes are summed where the row is, so no token is shuffled."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch[tokens]
            flat, cuts = words.flatten(), np.r_[0, np.cumsum(np.asarray(words.value_lengths().fill_null(0)))]
            bands = np.zeros((batch.num_rows, 4), dtype=np.int32)
            for i in range(batch.num_rows):
                sums, n = np.zeros(64, dtype=np.int64), int(cuts[i + 1] - cuts[i])
                for lo in range(int(cuts[i]), int(cuts[i + 1]), VOTES):
                    own = flat.slice(lo, min(VOTES, int(cuts[i + 1]) - lo)).to_pylist()
                    digests = np.frombuffer(b"".join(md5(w.encode()).digest()[:8] for w in own), ">u4").reshape(-1, 2)
                    sums += np.unpackbits(digests.astype("<u4").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                bands[i] = ((2 * sums > n).reshape(4, 16) << np.arange(16)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], *[pa.array(bands[:, i]) for i in range(4)]], names=[*keys, *[f"b{i}" for i in range(4)]])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, tokens).mapInArrow(vote, ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"b{i} int" for i in range(4)]]))


def simhash_pairs(bands: DataFrame, key: str, within: int = 3) -> DataFrame:
    """Pairs at Hamming distance at most ``within`` < 4: by pigeonhole they share a band, so the band join is exact."""
    own = bands.select(key, *[f"b{i}" for i in range(4)], F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("v")) for i in range(4)])).alias("band"))
    a, b = own.alias("a"), own.alias("b")
    gap = sum((F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}"))) for i in range(4)), F.lit(0))
    # a pair that shares several bands is met in the first of them alone
    shared = [F.when(F.col(f"a.b{i}") == F.col(f"b.b{i}"), i) for i in range(4)]
    met = (F.col("a.band") == F.col("b.band")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (gap <= within) & (F.col("a.band.i") == F.coalesce(*shared))
    return a.join(b, met).select(F.col(f"a.{key}").alias("left_id"), F.col(f"b.{key}").alias("right_id"), gap.cast("int").alias("distance"))


def matched_bins(rows: DataFrame, key: str, role: Column, stratum: list[str], ratio: int = 3, *, order: Column) -> DataFrame:
    """Each treated row with ``ratio`` controls of its stratum, by rank in a stable order, without replacement."""
    w = Window.partitionBy(*stratum, "_role").orderBy(order, key)
    ranked = rows.withColumn("_role", role).withColumn("_rn", F.row_number().over(w))
    treated = ranked.where("_role").select(*stratum, F.col(key).alias("treated"), F.col("_rn").alias("set"))
    control = ranked.where(~F.col("_role")).select(*stratum, F.col(key).alias("control"), F.ceil(F.col("_rn") / ratio).cast("int").alias("set"))
    return treated.join(control, [*stratum, "set"])
