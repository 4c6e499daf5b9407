"""Event logs and overlapping spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import clamp


def status_fold(events: DataFrame) -> DataFrame:
    """Per execution its first event, last state and last failure by time and sequence: last writer wins."""
    at = F.struct("at", "seq")
    return events.groupBy("execution").agg(
        F.count("*").alias("events"), F.min_by("type", at).alias("first_type"), F.max_by("type", at).alias("last_type"),
        F.max_by("seq", F.when(F.col("type") == "failed", at)).alias("last_failure"),
    )


def audit_evaluation(events: DataFrame) -> DataFrame:
    """Findings per execution (once per category and code), score and whether it is solved."""
    found = events.filter(F.col("type").isin("failed", "warned")).select(
        "execution", F.col("type").alias("category"), "code", (F.col("type") == "failed").alias("blocking")
    ).distinct()
    counted = found.groupBy("execution").agg(F.count_if("blocking").alias("blocking"), F.count_if(~F.col("blocking")).alias("warnings"))
    all_of = status_fold(events).join(counted, "execution", "left").fillna(0, ["blocking", "warnings"])
    solved = (F.col("last_type") == "completed") & (F.col("blocking") == 0)
    score = F.when(solved, 100).otherwise(72) - 12 * F.col("blocking") - 4 * F.col("warnings") - F.least(F.lit(15), 3 * F.col("warnings"))
    return all_of.select("execution", "events", "blocking", "warnings", solved.alias("solved"), clamp(score.cast("double"), 0.0, 100.0).cast("int").alias("score"))


def first_within(events: DataFrame, key: list[str], minutes: int = 10) -> DataFrame:
    """Requests that no equal request precedes by less than the time to live."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy(*key).orderBy("at", "seq"))
    return events.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") > minutes * 60_000_000)).drop("gap")


def interval_union(spans: DataFrame, key: str = "trace") -> DataFrame:
    """Merged intervals of each trace: ``start, end, spans``."""
    order = Window.partitionBy(key).orderBy("start", "end", "span")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("fresh", F.when(F.col("start") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    return cut.withColumn("island", F.sum("fresh").over(order)).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans"))


def coverage(spans: DataFrame, key: str = "trace") -> DataFrame:
    """Per trace: covered time, extent, what no span accounts for, and the longest span's share."""
    merged = interval_union(spans, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.min("start").alias("first"), F.max("end").alias("last"), F.count("*").alias("islands"))
    longest = spans.groupBy(key).agg(F.max(F.col("end") - F.col("start")).alias("longest"), F.count("*").alias("spans"))
    joined = merged.join(longest, key)
    extent = F.col("last") - F.col("first")
    return joined.select(key, "spans", "islands", "covered", extent.alias("extent"), (extent - F.col("covered")).alias("unaccounted"), "longest", ((extent - F.col("covered")) > 0.2 * extent).alias("gap_warning"))


def overlap_with(spans: DataFrame, low: int, high: int) -> DataFrame:
    return spans.withColumn("overlap", F.greatest(F.lit(0), F.least("end", F.lit(high)) - F.greatest("start", F.lit(low))))


#: Spans that a stretch of a trace holds, about; what a task looks at beside a span are the spans that run with it in its stretch.
STRETCH_SPANS = 2000


def _held(start: np.ndarray, end: np.ndarray, span: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans in order of start, the time inside their stretch that spans nested in each cover, and whether there are any.

    Stretches lie one after the other, each shifted beyond the end of the one before it; ``low`` and ``high`` are a row's borders.
    """
    used, some = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    first, last = np.searchsorted(start, start, "left"), np.searchsorted(start, end, "right")
    for k in np.flatnonzero(last - first > 1):
        at = slice(first[k], last[k])
        length, own = end[at] - start[at], end[k] - start[k]
        inside = (end[at] <= end[k]) & ((length < own) | ((length == own) & (span[at] > span[k])))
        if inside.any():
            some[k] = True
            s, e = np.maximum(start[at][inside], low[k]), np.minimum(end[at][inside], high[k])
            reach = np.maximum.accumulate(e)
            used[k] = np.maximum(0, e - np.maximum(s, np.r_[s[0], reach[:-1]])).sum()
    return used, some


def _shifted(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For every row what to add so that groups, which follow one another, do not overlap in time."""
    firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low, high = np.minimum.reduceat(start, firsts), np.maximum.reduceat(end, firsts)
    begins = np.r_[0, np.cumsum(high - low + 1)[:-1]]
    return np.repeat(begins - low, np.diff(np.r_[firsts, len(group)]))


def exclusive_time(spans: DataFrame, key: str = "trace", stretch_spans: int = STRETCH_SPANS) -> DataFrame:
    """Each span's time that no span nested in it covers; nested: inside it and shorter (or later by number).

    A trace is cut at time borders into stretches of about ``stretch_spans`` spans, no shorter than its mean span, so that a large trace
    is split over tasks. A span is carried over to every stretch that it reaches, as one that may hold others and as one that may be
    held; covered times of the stretches add up. A task takes all its stretches in one pass; no pairs of spans are written.
    """
    rows = spans.select(key, "span", "start", "end")
    length = F.col("end") - F.col("start")
    sizes = rows.groupBy(key).agg(F.min("start").alias("_low"), F.max("end").alias("_high"), F.count("*").alias("_n"), F.avg(length).alias("_mean"))
    width = F.greatest(F.lit(1.0), (F.col("_high") - F.col("_low") + 1) * stretch_spans / F.col("_n"), F.col("_mean"))
    sizes = sizes.select(key, "_low", F.ceil(width).cast("bigint").alias("_width"))
    of = lambda c: F.floor((F.col(c) - F.col("_low")) / F.col("_width")).cast("bigint")
    cut = rows.join(sizes, key).withColumn("_stretch", F.explode(F.sequence(of("start"), F.greatest(of("start"), of("end")))))
    begin = F.col("_low") + F.col("_stretch") * F.col("_width")
    dealt = cut.select(key, "span", "start", "end", "_stretch", begin.cast("bigint").alias("_begin"), (begin + F.col("_width")).cast("bigint").alias("_end"))
    dealt = dealt.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "start", "end", "span")

    def held(table: pa.Table) -> pa.RecordBatch:
        start, end, low, high = (table[c].to_numpy().astype(np.int64) for c in ("start", "end", "_begin", "_end"))
        names = table[key].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        group = np.cumsum(np.r_[True, (names[1:] != names[:-1]) | (low[1:] != low[:-1])])
        shift = _shifted(start, end, group)
        used, some = _held(start + shift, end + shift, table["span"].to_numpy(), low + shift, high + shift)
        out = table.select([key, "span", "start", "end"]).append_column("used", pa.array(used)).append_column("some", pa.array(some))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the rows of the last stretch, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*waiting, batch])
            last = pc.and_(pc.equal(whole["_stretch"], whole["_stretch"][-1]), pc.fill_null(pc.equal(whole[key], whole[key][-1]), whole[key][-1].as_py() is None))
            done = pc.index(last.combine_chunks(), True).as_py()
            if done:
                yield held(whole.slice(0, done))
            waiting = whole.slice(done).to_batches()
        if waiting:
            yield held(pa.Table.from_batches(waiting))

    kinds = dict(dealt.dtypes)
    parts = dealt.mapInArrow(run, f"{key} {kinds[key]}, span {kinds['span']}, start {kinds['start']}, end {kinds['end']}, used bigint, some boolean")
    whole = parts.groupBy(key, "span", "start", "end").agg(F.sum("used").alias("used"), F.bool_or("some").alias("has_nested"))
    return whole.select(key, "span", (F.col("end") - F.col("start") - F.col("used")).alias("exclusive"), "has_nested")
