"""Hard negatives: for each anchor and positive, the rows of other labels that score just below the positive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievefold.llm.shared import Scratch, keep_columns

#: Whole numbers up to here are exact as doubles, and so are sums that stay below.
EXACT = 1 << 53


@dataclass(frozen=True)
class NegativeRules:
    """How many positives and negatives, the limits in percent of the positive's score, and what a task holds.

    ``group`` anchors are sent to all tasks at once, ``chunk`` of them are scored at once against a
    batch; ``rows`` is about how many rows a task reads. None changes the result.
    """

    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    high_percent: int = 100
    scale: int = 256
    group: int = 20_000
    chunk: int = 128
    rows: int = 50_000


def whole_numbers(vectors: pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of each component as doubles, a row for each list; short lists end in zeros."""
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(float)[offsets[0] : offsets[-1]]
    most = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), most))
    if len(sizes) and (sizes == most).all():
        out[:] = flat.reshape(len(sizes), most)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        kept = at < most
        out[row[kept], at[kept]] = flat[kept]
    return np.floor(scale * out)


def scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact, as longs."""
    width = min(x.shape[1], a.shape[1])
    x, a = x[:, :width], a[:, :width]
    most = float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0)) * max(width, 1)
    if most < EXACT:
        return (x @ a.T).astype(np.int64)
    if most < 2.0**63:
        return x.astype(np.int64) @ a.astype(np.int64).T
    raise OverflowError("components so large that a score may not fit in a long")


@dataclass
class Anchors:
    """Some anchors as tasks hold them; slots are filled with what is sought for them."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray


class Best:
    """The best ``most`` rows of each slot so far: highest score, then smallest id, nulls last."""

    def __init__(self, most: int):
        self.most = most
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))  # slot, score, null id, id

    def add(self, found: list[tuple[np.ndarray, ...]]) -> None:
        if not found:
            return
        slot, score, absent, own = (np.concatenate(c) for c in zip(self.held, *found, strict=True))
        order = np.lexsort((own, absent, -score, slot))
        first = np.r_[0, np.flatnonzero(np.diff(slot[order])) + 1]
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        kept = order[rank < self.most]
        self.held = slot[kept], score[kept], absent[kept], own[kept]


def _pass(table: DataFrame, scale: int, chunk: int, most: int, sent, pick) -> DataFrame:
    """(slot, score, id): the best rows of each slot in each task.

    Each batch is scored against the anchors; an anchor's scores are sorted whole, by score and id, and
    ``pick(k, order, score, labels, rows)`` names (slot, places in that order) from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = sent.value["anchors"], Best(most)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch.column("x"), scale)
            absent = batch.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            own = batch.column("id").fill_null(0).to_numpy()
            labels, rows = batch.column("label").to_numpy(), batch.column("row").to_numpy()
            found = []
            for at in range(0, len(anchors.row), chunk):
                part = scores(x, anchors.x[at : at + chunk])
                for k in range(part.shape[1]):
                    s = part[:, k]
                    order = np.lexsort((own, absent, -s))
                    for slot, taken in pick(at + k, order, s[order], labels, rows):
                        if len(taken):
                            t = order[taken]
                            found.append((np.full(len(t), slot), s[t], absent[t], own[t]))
            best.add(found)
        slot, score, absent, own = best.held
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(score), pa.array(own, mask=absent.astype(bool))], names=["slot", "score", "id"])

    met = table.mapInArrow(run, "slot long, score long, id long")
    each = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return met.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= most)


def mine_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rules: NegativeRules = NegativeRules(), scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says which rows are anchors. An anchor's positives are the best other rows of its label;
    for each, the best rows of other labels within the limits are returned. Scores are inner products
    of floor(scale * x); of vectors of different lengths the shorter one ends in zeros. The
    whole table meets the anchors in blocks: ``group`` anchors go to all tasks, which hold the best rows
    of each anchor and positive and no more, and send these once; rows are dealt out once, by turns, so no label, id or
    vector is a key. A second pass, which knows each positive's limits, finds the negatives.

    Rows with a null label, a null vector or a component that is null or not finite take no part. An
    anchor without positives, and a positive without rows within its limits, has no rows. Equal scores
    are in the order of ids, null ids last; null ids may be positives or negatives and are anchors if
    ``anchors`` says so. A repeated row is a row of its own: another row to its copy, and an anchor again. An empty
    table gives an empty result; other columns are ignored. Components so large that a score might not fit in a
    long raise. The result reads tables in ``scratch``.
    """
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession)
    inner = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = inner.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // rules.rows))
    table = scratch.table(kept.repartition(parts).withColumn("row", F.monotonically_increasing_id()), "rows")
    chosen = table.filter("anchor").drop("anchor")
    results, last = [], -1
    while (part := chosen.filter(F.col("row") > last).orderBy("row").limit(rules.group).toArrow().combine_chunks()).num_rows:
        last = part.column("row")[-1].as_py()
        plain = lambda c: part.column(c).combine_chunks()  # noqa: E731, B023
        group = Anchors(plain("row").to_numpy(), np.array(plain("id").to_pylist(), object), plain("label").to_numpy(), whole_numbers(plain("x"), rules.scale))
        results.append(_of_group(table, group, rules, scratch))
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(kinds).parquet(*results) if results else spark.createDataFrame([], kinds)


def _of_group(table: DataFrame, anchors: Anchors, rules: NegativeRules, scratch: Scratch) -> str:
    """Where the rows of some anchors were written."""
    context, p = table.sparkSession.sparkContext, rules.positives
    sent = context.broadcast({"anchors": anchors})

    def same(k, order, score, labels, rows):
        mine = (labels[order] == sent.value["anchors"].label[k]) & (rows[order] != sent.value["anchors"].row[k])
        yield k, np.flatnonzero(mine)[:p]

    found = _pass(table.select("id", "label", "x", "row"), rules.scale, rules.chunk, p, sent, same).collect()  # ``positives`` rows for each anchor of the group
    sent.unpersist()
    # slots of the second pass are pairs of an anchor and a positive; limits[k] are those of anchor k
    pairs = sorted((r["slot"], r["rank"], r["id"], r["score"]) for r in found)
    limits: list[list[tuple[int, int, int]]] = [[] for _ in anchors.row]
    for slot, (k, _, _, s) in enumerate(pairs):
        limits[k].append((slot, -(-rules.low_percent * s // 100), rules.high_percent * s // 100))
    sent = context.broadcast({"anchors": anchors, "limits": limits})

    def others(k, order, score, labels, rows):
        wanted = sent.value["limits"][k]
        if not wanted:
            return
        other = np.flatnonzero(labels[order] != sent.value["anchors"].label[k])
        down = -score[other]  # ascends
        for slot, low, high in wanted:
            if low <= high:
                start, end = np.searchsorted(down, -high, "left"), np.searchsorted(down, -low, "right")
                yield slot, other[start : min(end, start + rules.negatives)]

    mined = _pass(table.select("id", "label", "x", "row"), rules.scale, rules.chunk, rules.negatives, sent, others)
    named = table.sparkSession.createDataFrame([(slot, anchors.id[k], own, s) for slot, (k, _, own, s) in enumerate(pairs)], "slot long, anchor_id long, positive_id long, positive_score long")
    out = mined.join(F.broadcast(named), "slot")  # group * positives rows at most
    path = scratch.write(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    sent.unpersist()
    return path
