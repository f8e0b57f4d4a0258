"""Removal of word sequences that occur elsewhere, by level-wise doubling."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievefold.llm.shared import Scratch, keep_columns, row_keys, slices, split_words

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class SubstringRules:
    """``window`` words must recur; ``start`` is the first level's length.

    ``start`` words and twice that, less one at most, make a window: each
    level's windows are at least half as long as the next level's.
    """

    window: int = 35
    start: int = 9
    batch_bytes: int = 4 << 20

    def levels(self) -> list[int]:
        """start, 2 start, 4 start, ... up to the window."""
        if not 0 < self.start < self.window < 2048:
            raise ValueError("the first level must be shorter than the window, and the window than 2048 words")
        out = [self.start]
        while out[-1] < self.window:
            out.append(min(2 * out[-1], self.window))
        return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes, not symmetric."""
    x = (a ^ (a >> np.uint64(31))) * _ODD + b
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` words, by doubling; windows may run into the next text."""
    n = max(0, len(words) - length + 1)
    h, have = words, 1
    while have < length:
        step = min(have, length - have)  # the last step overlaps: two windows cover the whole
        h, have = _join(h[: len(h) - step], h[step:]), have + step
    return h[:n]


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, where its least lies; the first of equals."""
    at, best, have = np.arange(len(h)), h, 1
    while have < width:
        step = min(have, width - have)
        later = best[step:] < best[: len(best) - step]
        at = np.where(later, at[step:], at[: len(at) - step])
        best = np.where(later, best[step:], best[: len(best) - step])
        have += step
    return at


class Texts:
    """Words of a batch of texts, and two independent 64-bit hashes of each once they are asked for."""

    def __init__(self, texts: pa.Array):
        self.words, rows = split_words(texts)
        self.rows = rows.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = np.bincount(self.rows, minlength=len(texts))
        self.first = np.r_[0, np.cumsum(self.counts)]

    @functools.cached_property
    def pairs(self) -> np.ndarray:
        coded, digest = self.words.dictionary_encode(), xxhash.xxh3_128_digest
        each = np.frombuffer(b"".join([digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()]), "<u8").reshape(-1, 2)
        return each[coded.indices.to_numpy(zero_copy_only=False)]

    @functools.cached_property
    def one(self) -> np.ndarray:
        return np.ascontiguousarray(self.pairs[:, 0])

    @functools.cached_property
    def two(self) -> np.ndarray:
        return np.ascontiguousarray(self.pairs[:, 1])

    def starts(self, length: int) -> np.ndarray:
        """Positions where a window lies within its text."""
        at = np.arange(max(0, len(self.rows) - length + 1))
        return at[self.rows[at] == self.rows[at + length - 1]] if len(at) else at

    def anchors(self, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, the place each window picks, hashes of all places).

        Of its sub-windows of ``length`` words a window picks the one with
        the least hash, so equal windows pick equal sub-windows.
        """
        h = window_hashes(self.one, length)
        at = self.starts(window)
        picked = least_positions(h, window - length + 1)[at] if len(at) else at
        return at, picked, h


def _local(positions: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    rows = texts.rows[positions]
    return rows, positions - texts.first[rows]


_SHIFT = 1 << 12  # a run of windows is start * _SHIFT + length in one long


def _given(batch: pa.RecordBatch, texts: Texts, column: str) -> np.ndarray:
    """Marks at the positions in the runs that ``column`` lists for each text."""
    lists = batch.column(column)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    starts, lengths = np.divmod(pc.list_flatten(lists).to_numpy(zero_copy_only=False), _SHIFT)
    delta = np.zeros(len(texts.rows) + 1, np.int64)
    np.add.at(delta, starts + texts.first[rows], 1)
    np.add.at(delta, starts + texts.first[rows] + lengths, -1)
    return np.cumsum(delta) > 0


def _rows_of(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(rows)) for c in ("k1", "k2")]


def _gathered(runs: DataFrame) -> DataFrame:
    """(k1, k2, places): the runs of each document."""
    return runs.groupBy("k1", "k2").agg(F.collect_set("run").alias("places"))


def _repeated(places: DataFrame, scratch: Scratch) -> DataFrame:
    """The places (k1, k2, run) whose hash h occurs twice or more.

    Hashes are counted in part before the shuffle. The repeated ones are written, so that
    places meet them in a join of two exchanges, where those of one very common
    hash are dealt over tasks as a skewed key.
    """
    often = scratch.table(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    return places.join(often, "h", "left_semi").select("k1", "k2", "run")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SubstringRules = SubstringRules(), scratch: Scratch | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) of each document.

    A word goes if a window of ``window`` words over it starts anywhere else
    too. Levels: sub-windows of ``start`` words, of which each window picks
    its least, are counted over the corpus; where one recurs, windows of
    twice the length are tried, up to the whole window, so that most text is out after
    the first level. The last level has hashes of 128 bits.

    At the last level the windows that picked one sub-window stand side by side
    and are first compared as a whole, by the hashes of the first and the last
    of them; what isn't settled so is compared window by window, with one
    specimen of each settled group of the same sub-window. Both have 128 bits.

    Texts are shuffled once, into buckets by a hash of id and text that all levels and the
    result read; only places are shuffled after that. Positions of one document
    are gathered, never those of one hash. Tables are in ``scratch``, which the result reads.
    Rows with equal id and text count as two texts and get equal
    results; null ids are kept apart from others; null and empty texts have
    no words; an empty table gives an empty result; other columns are ignored.
    """
    levels = rules.levels()
    scratch = scratch or Scratch(docs.sparkSession)
    k1, k2 = row_keys("id", "text")
    inner = keep_columns(docs, {"id": id_col, "text": text_col}).withColumns({"k1": k1, "k2": k2})
    id_kind = inner.schema["id"].dataType.simpleString()
    window, size = rules.window, rules.batch_bytes

    def out(part: pa.RecordBatch, held: Texts, start: np.ndarray, n, **hashes: np.ndarray) -> pa.RecordBatch:
        rows, at = _local(start, held)
        return pa.RecordBatch.from_arrays([*_rows_of(part, rows), pa.array(at * _SHIFT + n), *(pa.array(h.view(np.int64)) for h in hashes.values())], names=["k1", "k2", "run", *hashes])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", size):
            held = Texts(part.column("text"))
            _, picked, h = held.anchors(levels[0], window)
            picked = np.unique(picked)
            yield out(part, held, picked, 1, h=h[picked])

    def longer(length: int, before: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text", size):
                held = Texts(part.column("text"))
                _, picked, _ = held.anchors(before, window)
                _, place, h = held.anchors(length, window)
                place = np.unique(place[_given(part, held, "places")[picked]])
                yield out(part, held, place, 1, h=h[place])

        return run

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", size):
            held = Texts(part.column("text"))
            at, picked, h = held.anchors(levels[-2], window)
            alive = _given(part, held, "places")[picked]
            at, picked = at[alive], picked[alive]
            new = np.r_[True, picked[1:] != picked[:-1]][: len(at)]
            low, n = at[new], np.bincount(np.cumsum(new) - 1, minlength=int(new.sum()))
            one, two = window_hashes(held.one, window), window_hashes(held.two, window)
            yield out(part, held, low, n, h=h[picked[new]], s1=_join(one[low], one[low + n - 1]), s2=_join(two[low], two[low + n - 1] + n.astype(np.uint64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", size):
            held = Texts(part.column("text"))
            one, two = window_hashes(held.one, window), window_hashes(held.two, window)
            for column, settled in (("once", 0), ("often", 1)):
                at = np.flatnonzero(_given(part, held, column))
                got = out(part, held, at, 1, s1=one[at], s2=two[at])
                yield got.append_column("settled", pa.array(np.full(len(at), settled, np.int32)))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", size):
            held = Texts(part.column("text"))
            starts = np.flatnonzero(_given(part, held, "places"))
            delta = np.zeros(len(held.rows) + 1, np.int64)
            np.add.at(delta, starts, 1)
            np.add.at(delta, starts + window, -1)
            kept = np.cumsum(delta[:-1]) == 0
            n_kept = np.bincount(held.rows, kept, part.num_rows).astype(np.int64)
            ends = pa.array(np.r_[0, np.cumsum(n_kept)].astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, held.words.filter(pa.array(kept))), " ")
            shas = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in joined.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(held.counts.astype(np.int64)), pa.array(held.counts.astype(np.int64) - n_kept), shas, joined],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    run, empty = "k1 long, k2 long, run long", F.array().cast("array<long>")
    dealt = scratch.bucketed(inner, "texts", "k1", "k2")
    texts = dealt.select("k1", "k2", "text")
    kind = StructType.fromDDL(f"{run}, h long")
    path = scratch.write(texts.mapInArrow(first, kind), "places")
    for before, length in zip(levels, levels[1:-1], strict=False):
        alive = _gathered(_repeated(scratch.read(path, kind), scratch))
        path, old = scratch.write(texts.join(alive, ["k1", "k2"]).mapInArrow(longer(length, before), kind), "places"), path
        scratch.drop(old)
    alive = _gathered(_repeated(scratch.read(path, kind), scratch))
    spans = scratch.table(texts.join(alive, ["k1", "k2"]).mapInArrow(groups, f"{run}, h long, s1 long, s2 long"), "groups")
    scratch.drop(path)
    counted = scratch.table(spans.groupBy("h", "s1", "s2").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "run")).alias("one")), "spans")
    open_ = scratch.table(counted.filter("c = 1").select("h").distinct(), "open")
    tried = counted.join(open_, "h", "left_semi").groupBy("one.k1", "one.k2").agg(*[F.collect_set(F.when(test, F.col("one.run"))).alias(n) for n, test in (("once", F.col("c") == 1), ("often", F.col("c") > 1))])
    windows = scratch.table(texts.join(tried, ["k1", "k2"]).mapInArrow(each, f"{run}, s1 long, s2 long, settled int"), "windows")
    often = scratch.table(windows.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.max("settled").alias("settled")).filter("n > 1 or settled = 1").select("s1", "s2"), "often")
    some = windows.filter("settled = 0").join(often, ["s1", "s2"], "left_semi").select("k1", "k2", "run")
    whole = spans.join(counted.filter("c > 1").select("s1", "s2"), ["s1", "s2"], "left_semi").select("k1", "k2", "run")
    marked = dealt.join(_gathered(some.unionAll(whole)), ["k1", "k2"], "left").select("id", "text", F.coalesce("places", empty).alias("places"))
    result = marked.mapInArrow(last, f"id {id_kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return result.withColumnRenamed("id", id_col)
