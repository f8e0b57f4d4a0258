"""SimHash fingerprints, and near duplicates by tiled exact comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sievefold.llm.components import components
from sievefold.llm.shared import Scratch, hashable, keep_columns, row_keys, slices

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: For a byte, a 64-bit word whose eight lanes hold its bits, lowest lane first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


@dataclass(frozen=True)
class SimhashRules:
    """Shingle length in words, link radius in bits, and how tiles are cut.

    ``segments`` cuts a fingerprint into that many parts of equal width; a
    tile holds fingerprints whose parts have the same population counts.
    ``tile`` bounds the fingerprints in one block of a tile.
    """

    shingle: int = 3
    radius: int = 2
    segments: int = 4
    tile: int = 2048
    seed: int = 42
    batch_bytes: int = 4 << 20


def shingle_hashes(text: str, k: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a text of fewer words is one shingle."""
    words = text.encode("utf-8").translate(_LOWER).split()  # bytes split at space and \t \n \v \f \r only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hashes give zero."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    lanes = _LANES[octets]  # n x 8 words of eight byte-wide counters
    starts = np.arange(0, n, 255)
    sums = np.add.reduceat(lanes, starts, axis=0)  # no lane overflows in 255 rows
    counts = sums.view(np.uint8).reshape(len(starts), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SimhashRules = SimhashRules()) -> DataFrame:
    """(id, fp as signed long) of each row, in one narrow pass over whole texts."""
    inner = keep_columns(docs, {"id": id_col, "text": text_col})

    return _fingerprints(inner, rules)


def _fingerprints(inner: DataFrame, rules: SimhashRules) -> DataFrame:
    """``inner`` has text and other columns, which are kept."""
    others = [c for c in inner.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", rules.batch_bytes):
            found = [fingerprint(shingle_hashes(t or "", rules.shingle, rules.seed)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(part.column, others), pa.array(np.array(found, np.uint64).view(np.int64))], names=[*others, "fp"])

    kinds = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in others)
    return inner.mapInArrow(run, f"{kinds}, fp long")


def _parts(fp: Column, segments: int) -> list[Column]:
    width = 64 // segments
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit(mask if width < 64 else -1))) for k in range(segments)]


def _steps(segments: int, radius: int) -> list[int]:
    """Differences of tile keys within the radius, one of each pair of opposites.

    A key holds a population count in each 8 bits; two fingerprints within
    the radius have counts whose differences add up to the radius at most.
    """
    found = [d for d in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius]
    return sorted({sum(x << (8 * k) for k, x in enumerate(d)) for d in found if d >= (0,) * segments})


class Forest:
    """Edges that join the nodes of one task, none of which closes a circle."""

    def __init__(self, nodes: int):
        self.label = np.arange(nodes)
        self.left: list[int] = []
        self.right: list[int] = []

    def join(self, node: int, others: np.ndarray) -> None:
        """Links a node with others, by one edge for each component that it reaches so."""
        roots, first = np.unique(self.label[others], return_index=True)
        for root, k in zip(roots.tolist(), first.tolist(), strict=True):
            if root != self.label[node]:
                self.label[self.label == root] = self.label[node]
                self.left.append(node)
                self.right.append(int(others[k]))


def spanning(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest with the components of all links between a and b.

    Exclusive-or and bit counts of all pairs, some rows at a time. Each link is exact,
    so none that the forest leaves out could join anything more.
    """
    nodes = np.concatenate([a, b])
    found = Forest(len(nodes))
    rows = max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(1)).tolist():
            found.join(at + i, np.flatnonzero(near[i]) + len(a))
    return nodes[found.left], nodes[found.right]


def links(distinct: DataFrame, rules: SimhashRules, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, a forest for each pair of blocks.

    ``distinct`` has fp, each once. Fingerprints with the same population
    counts are cut into blocks of about ``tile``; blocks meet only if their
    counts differ by the radius at most, and each such pair of blocks is
    compared exactly in numpy. Pairs of block numbers are formed first and are
    the key by which blocks are sent, so the pairs of a very full tile are
    spread over as many tasks as there are.
    """
    key = sum((p.cast("long") * F.lit(1 << (8 * k)) for k, p in enumerate(_parts(F.col("fp"), rules.segments))), F.lit(0).cast("long"))
    keyed = distinct.select("fp", key.alias("key"))
    sizes = scratch.table(keyed.groupBy("key").agg(F.ceil(F.count("*") / rules.tile).cast("long").alias("blocks")), "sizes")
    numbered = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    blocks = scratch.table(numbered.repartition("key", "block").groupBy("key", "block").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(rules.segments, rules.radius)])
    each = sizes.select(F.col("key").alias("key_a"), F.col("blocks").alias("n_a"), F.explode(steps).alias("step"))
    near = each.join(sizes.select(F.col("key").alias("key_b"), F.col("blocks").alias("n_b")), F.col("key_a") + F.col("step") == F.col("key_b"))
    for side in "ab":
        near = near.withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{side}") - 1)))
    pairs = near.filter((F.col("step") != 0) | (F.col("block_a") <= F.col("block_b"))).select("key_a", "block_a", "key_b", "block_b")
    for side in "ab":
        pairs = pairs.join(blocks.select(F.col("key").alias(f"key_{side}"), F.col("block").alias(f"block_{side}"), F.col("fps").alias(side)), [f"key_{side}", f"block_{side}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy() for c in ("a", "b"))
                x, y = spanning(a, b, rules.radius)
                out_a.append(x)
                out_b.append(y)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    # written, so that no task has a second Python worker for what reads the edges; workers are kept with their memory
    return scratch.table(pairs.select("a", "b").mapInArrow(run, "a long, b long").filter(F.col("a") != F.col("b")), "near")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SimhashRules = SimhashRules(), scratch: Scratch | None = None) -> DataFrame:
    """(id, fingerprint in hex, component_id) of each row.

    Equal fingerprints are one node, so copies cost nothing further; links
    join nodes that differ in ``radius`` bits at most, and ``component_id`` is the
    smallest id reachable. Null and empty texts have fingerprint zero and are
    linked like any other. Null ids are never a component's id unless it has
    no other. Repeated rows get equal results; an empty table gives an empty
    result; other columns are ignored. The result reads tables in ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    prints = scratch.table(fingerprints(docs, id_col, text_col, rules), "prints")
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), rules, scratch), scratch)
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = scratch.table(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    of_fp = scratch.table(named.join(ids, "root").select("fp", "component_id"), "of_fp")
    out = prints.join(of_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class NearRules:
    """Shingle length in words, how candidates are found, and how they are dealt out.

    A band joins ``rows`` minima of a set of shingles; two sets of Jaccard
    similarity s agree in one with probability s to the power ``rows``. There are so
    many bands that a pair at the asked similarity meets in none of them with
    probability ``miss`` at most, whatever the texts.

    Texts whose fingerprints of the same shingles differ by ``radius`` bits at most are candidates too.

    ``block`` bounds the texts, and ``block_shingles`` about bounds the shingles, of a
    block; a family of more than ``family`` texts is cut by the sketches of its texts first.
    """

    shingle: int = 5
    rows: int = 6
    miss: float = 1e-6
    seed: int = 42
    block: int = 256
    block_shingles: int = 1 << 19
    family: int = 8192
    radius: int = 2
    batch_bytes: int = 4 << 20

    def bands(self, similarity: float) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - min(similarity, 1 - 1e-9) ** self.rows))


#: Groups for filtering: five-word shingles.
DEDUP = NearRules()


#: Bytes of a sketch, at most one for each order.
SKETCH = 128


def shingle_set(text: str | None, rules: NearRules) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    return np.unique(shingle_hashes(text or "", rules.shingle, rules.seed))


class Bands:
    """Minima of a set of hashes under many orders, its buckets, and a sketch; no buckets for an empty set."""

    def __init__(self, rules: NearRules, similarity: float):
        rng, shape = np.random.default_rng(rules.seed), (rules.bands(similarity), rules.rows)
        self.order = rng.integers(0, 1 << 31, shape, np.uint32).ravel() * np.uint32(2) + np.uint32(1)
        self.mix = rng.integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)
        self.start = rng.integers(0, 1 << 63, shape[0], np.uint64)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.order), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(high), 1024):
            np.minimum(least, np.multiply.outer(self.order, high[at : at + 1024]).min(1), out=least)
        return least

    def buckets(self, least: np.ndarray) -> np.ndarray:
        """A number for each band."""
        return ((least.reshape(self.mix.shape) * self.mix).sum(1, dtype=np.uint64) + self.start).view(np.int64)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(buckets, sketch): a byte of each of some minima."""
        if not len(hashes):
            return np.zeros(0, np.int64), b""
        least = self.minima(hashes)
        return self.buckets(least), least[:SKETCH].astype(np.uint8).tobytes()


def _banded(inner: DataFrame, rules: NearRules, similarity: float) -> DataFrame:
    """(id, k1, k2, node, n, fp, bands, sketch): digest and size of each text's set of shingles, its fingerprint, buckets and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(rules, similarity)
        for part in slices(batches, "text", rules.batch_bytes):
            hashes = [shingle_hashes(t or "", rules.shingle, rules.seed) for t in part.column("text").to_pylist()]
            prints, sets = pa.array(np.array(list(map(fingerprint, hashes)), np.uint64).view(np.int64)), list(map(np.unique, hashes))
            nodes = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            found = [bands(x) for x in sets]
            own = [pa.array([len(x) for x in sets], pa.int64()), pa.array([b for b, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(part.column, ("id", "k1", "k2")), nodes, own[0], prints, *own[1:]], names=["id", "k1", "k2", "node", "n", "fp", "bands", "sketch"])

    return inner.select("id", "k1", "k2", "text").mapInArrow(run, f"id {inner.schema['id'].dataType.simpleString()}, k1 long, k2 long, node binary, n long, fp long, bands array<long>, sketch binary")


def _with_sets(texts: DataFrame, rules: NearRules) -> DataFrame:
    """``texts`` with the sorted hashes of each text's shingles in place of the text."""
    others = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", rules.batch_bytes):
            found = [shingle_set(t, rules).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), pa.array(found, pa.binary())], names=[*(f.name for f in others), "payload"])

    return texts.mapInArrow(run, StructType([*others, StructField("payload", BinaryType())]))


def common(sets: list[np.ndarray], rows: int, first: int) -> np.ndarray:
    """How many hashes the first ``rows`` sets share with those from ``first`` on.

    Products of 0/1 matrices over the hashes that two sets or more hold, some
    columns at a time.
    """
    sizes = [len(x) for x in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[column] > 1)
    shared = shared[np.argsort(column[shared], kind="stable")]
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    out = np.zeros((rows, len(sets) - first), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        held = np.zeros((len(sets), min(width, int(column[-1]) + 1 - at)), np.float32)
        held[owner[low:high], column[low:high] - at] = 1
        out += held[:rows] @ held[first:].T
    return out


#: Compares texts of one tile by what is known of them: (those of side 0, those of side 1, whether side 0 among
#: itself too), giving the edges of a forest with the components of all links. Numbers of side 1 follow those of side 0.
Compare = Callable[[list[bytes], list[bytes], bool], tuple[list[int], list[int]]]


def _forest(near: np.ndarray, first: int, nodes: int) -> tuple[list[int], list[int]]:
    """``near`` says which of the first texts, by rows, are linked to those from ``first`` on, by columns."""
    found = Forest(nodes)
    for i in np.flatnonzero(near.any(1)).tolist():
        found.join(i, np.flatnonzero(near[i]) + first)
    return found.left, found.right


def alike(similarity: float) -> Compare:
    """Links of a Jaccard similarity of ``similarity`` at least, between sorted sets of hashes."""

    def compare(a: list[bytes], b: list[bytes], inside: bool) -> tuple[list[int], list[int]]:
        sets, first = [np.frombuffer(x, np.uint64) for x in (*a, *b)], 0 if inside else len(a)
        sizes = np.array([len(x) for x in sets], np.float64)
        both = common(sets, len(a), first)
        return _forest(both >= similarity * (sizes[: len(a), None] + sizes[None, first:] - both), first, len(sets))

    return compare


def plausible(similarity: float) -> Compare:
    """Pairs whose sketches agree as often as those of such a similarity do, less five standard deviations."""
    least = SKETCH * similarity - 5 * math.sqrt(SKETCH * similarity * (1 - similarity))

    def compare(a: list[bytes], b: list[bytes], inside: bool) -> tuple[list[int], list[int]]:
        every, first = np.frombuffer(b"".join([*a, *b]), np.uint8).reshape(-1, SKETCH), 0 if inside else len(a)
        near = [(every[at : min(at + 32, len(a)), None] == every[None, first:]).sum(2) >= least for at in range(0, len(a), 32)]
        return _forest(np.concatenate(near), first, len(every))

    return compare


def _linked(rows: DataFrame, rules: NearRules, compare: Compare, inside: bool) -> DataFrame:
    """Links (a, b) of each tile: rows of (g, i, j, side, node, payload).

    A tile's rows are sorted together and streamed, so a task holds one tile. Texts
    of side 0 are compared with those of side 1, and among themselves if ``inside``
    or if there are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, known = None, ([], []), ([], [])

        def edges() -> pa.RecordBatch:
            every = nodes[0] + nodes[1]
            left, right = compare(*known, inside or not known[1]) if known[0] and len(every) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([every[k] for k in x], pa.binary()) for x in (left, right)], names=["a", "b"])

        for part in slices(batches, "payload", rules.batch_bytes):
            keys = list(zip(*(part.column(c).to_pylist() for c in ("g", "i", "j")), strict=True))
            for key, side, node, payload in zip(keys, *(part.column(c).to_pylist() for c in ("side", "node", "payload")), strict=True):
                if key != now:
                    if now is not None:
                        yield edges()
                    now, nodes, known = key, ([], []), ([], [])
                nodes[side].append(node)
                known[side].append(payload)
        if now is not None:
            yield edges()

    dealt = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.select("g", "i", "j", "side", "node", "payload").mapInArrow(run, "a binary, b binary").filter(F.col("a") != F.col("b"))


def candidates(nodes: DataFrame, similarity: float, rules: NearRules, scratch: Scratch) -> DataFrame:
    """(g, node, n): groups of texts, such that any two that share a bucket and can be alike share a group.

    ``nodes`` has code, node, n, bands and sketch. Texts joined by buckets are a family. One of more than
    ``rules.family`` texts may only hang together by chance: the sketches of its
    texts are compared in each bucket, and those joined by plausible pairs are a group.
    """
    each = nodes.select("code", F.explode("bands").alias("bucket"))
    least = each.groupBy("bucket").agg(F.min("code").alias("low"), F.max("code").alias("high")).filter("low < high").select("bucket", "low")
    met = scratch.table(each.join(scratch.table(least, "buckets"), "bucket").select("bucket", "code", "low"), "met")
    roots = components(met.select(F.col("code").alias("a"), F.col("low").alias("b")), scratch)
    family = met.select("code").distinct().join(roots, F.col("code") == F.col("node"), "left").select("code", F.coalesce("root", "code").alias("family"))
    family = scratch.table(family, "families")
    sizes = scratch.table(family.groupBy("family").agg(F.count("*").alias("m")), "sizes")
    sized = family.join(sizes, "family")
    own = nodes.select("code", "node", "n")
    whole = sized.filter(F.col("m") <= rules.family).join(own, "code").select(F.col("family").alias("g"), "node", "n")
    large = sizes.filter(F.col("m") > rules.family)
    if large.isEmpty():
        return whole
    wide = scratch.table(sized.join(large.select("family"), "family", "left_semi").select("code").join(nodes.select("code", "node", F.col("sketch").alias("payload")), "code"), "wide")
    members = wide.select("code", "node").join(met, "code").select(F.col("bucket").alias("g"), "node", F.lit(1).cast("long").alias("n"))
    joined = block_links(members, wide.select("node", "payload"), plausible(similarity), rules, scratch)
    named = joined.select("node", "root").unionAll(joined.select(F.col("root").alias("node"), "root").distinct())
    return whole.unionAll(named.join(own, "node").select(F.xxhash64("root").alias("g"), "node", "n"))


def by_fingerprint(prints: DataFrame, rules: NearRules, scratch: Scratch) -> DataFrame:
    """(g, node, n): groups of texts that links between their SimHash fingerprints join, those of several texts.

    ``prints`` has node, n and fp. Texts of one set of shingles may differ in their repeats, so a node may have several fingerprints.
    """
    each = scratch.table(prints.select("node", "n", "fp").distinct(), "fingerprints")
    near = links(each.select("fp").distinct(), SimhashRules(shingle=rules.shingle, radius=rules.radius, seed=rules.seed), scratch)
    roots = components(near, scratch).withColumnRenamed("node", "fp")
    named = scratch.table(each.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "node", "n").distinct(), "alike")
    several = scratch.table(named.groupBy("root").agg(F.count("*").alias("m")).filter("m > 1").select("root"), "several")
    return named.join(several, "root").select(F.xxhash64(F.lit("simhash"), "root").alias("g"), "node", "n")


def _up_to(n: Column) -> Column:
    """0, 1, ... n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))


def block_links(members: DataFrame, payloads: DataFrame, compare: Compare, rules: NearRules, scratch: Scratch) -> DataFrame:
    """(node, root) of texts linked to others: components of all links in groups, those that aren't a root.

    ``members`` has g, node and n, ``payloads`` node and payload, each node once. A group is cut into blocks. Each
    block is compared inside and with the group's first block; that is linear in the group. What links have
    joined to the group's largest component by then needs no comparison among itself;
    the texts outside are compared in blocks with one another and with all texts of the component.
    """
    members = scratch.table(members, "members")
    blocks = F.greatest(F.ceil(F.count("*") / rules.block), F.ceil(F.sum("n") / rules.block_shingles)).cast("long")
    sizes = scratch.table(members.groupBy("g").agg(blocks.alias("blocks")), "blocks")
    placed = scratch.table(members.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "placed")

    # a text is in the tile of its block, and one of the first block in the tiles of all others too
    place = lambda i, side: F.struct(i.alias("i"), F.lit(side).alias("side"))
    others = F.transform(_up_to(F.when(F.col("block") == 0, F.col("blocks") - 1).otherwise(F.lit(0).cast("long"))), lambda k: place(k + 1, 1))
    tiles = F.concat(F.array(place(F.col("block"), 0)), others)
    first = placed.select("g", "node", F.explode(tiles).alias("t")).select("g", F.col("t.i").alias("i"), F.lit(0).cast("long").alias("j"), F.col("t.side").alias("side"), "node")
    held = scratch.table(_linked(first.join(payloads, "node"), rules, compare, True), "links")
    roots = components(held, scratch)

    # groups of several blocks that are not one component yet
    many = placed.filter("blocks > 1").join(roots.withColumnRenamed("root", "label"), "node", "left").select("g", "node", "n", F.coalesce("label", "node").alias("label"))
    labels = many.groupBy("g", "label").agg(F.count("*").alias("c"))
    open_ = scratch.table(labels.groupBy("g").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("k")).filter("k > 1").select("g", F.col("top.label").alias("main")), "open")
    if open_.isEmpty():
        return roots
    rest = scratch.table(many.join(open_, "g").select("g", "node", "n", (F.col("label") == F.col("main")).alias("joined")), "rest")
    count = lambda test: F.greatest(F.ceil(F.count_if(test) / rules.block), F.ceil(F.sum(F.when(test, F.col("n")).otherwise(0)) / rules.block_shingles)).cast("long")
    sizes = scratch.table(rest.groupBy("g").agg(count(~F.col("joined")).alias("out"), count(F.col("joined")).alias("in")), "rest_blocks")
    cut = rest.join(sizes, "g").withColumn("k", F.pmod(F.xxhash64("node"), F.when(F.col("joined"), F.col("in")).otherwise(F.col("out"))))
    tile = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side"))
    k = F.col("k")
    outside = F.concat(
        F.transform(_up_to(F.col("out")), lambda o: F.when(o < k, tile(o, k, 1)).otherwise(tile(k, o, 0))),
        F.transform(_up_to(F.col("in")), lambda m: tile(k, -1 - m, 0)),
    )
    inside = F.transform(_up_to(F.col("out")), lambda o: tile(o, -1 - k, 1))
    second = cut.select("g", "node", F.explode(F.when(F.col("joined"), inside).otherwise(outside)).alias("t")).select("g", "t.i", "t.j", "t.side", "node")
    more = scratch.table(_linked(second.join(payloads, "node"), rules, compare, False), "more_links")
    return components(held.unionAll(more), scratch)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearRules = DEDUP, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near duplicates, with all its columns.

    Texts with the same set of shingles are one node; two nodes are linked if the
    Jaccard similarity of their sets is at least ``similarity``, and a group is all
    that links reach. Candidates are joined by SimHash fingerprints, as in ``near_duplicates``, or, since at
    such a similarity many pairs differ in more bits, share a bucket; links are verified before any
    groups are formed. The smallest id of a group stays (null ids only if there is
    no other), of equal ids the smallest hash of id and text, and of rows equal in both the
    one whose columns have the least hash. Null and empty texts, as all without a word, are
    one group; an empty table gives an empty result; columns may have any names. The
    result reads tables in ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    k1, k2 = row_keys("id", "text")
    inner = keep_columns(docs, {"id": id_col, "text": text_col}).withColumns({"k1": k1, "k2": k2})
    prints = scratch.table(_banded(inner, rules, similarity), "prints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    nodes = prints.groupBy("node").agg(F.min(order).alias("least"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")])
    nodes = scratch.table(nodes.withColumn("code", F.xxhash64("node")), "nodes")
    members = by_fingerprint(prints, rules, scratch).unionAll(candidates(nodes, similarity, rules, scratch))
    members = scratch.table(members, "candidates")
    wanted = members.select("node").distinct().join(nodes, "node").select("node", "least.k1", "least.k2")
    # rows that are equal in id and text share their keys: one of them is as good as another
    texts = inner.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "text")
    sets = scratch.table(_with_sets(texts, rules), "sets")
    roots = block_links(members, sets, alike(similarity), rules, scratch).withColumnRenamed("node", "of")
    best = nodes.join(roots, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    stay = best.select("least.k1", "least.k2")
    own = row_keys(f"`{id_col}`", f"`{text_col}`")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own[0].alias("k1"), own[1].alias("k2"), F.xxhash64(*hashable(docs)).alias("rank"))
    kept = keyed.join(stay, ["k1", "k2"], "left_semi")
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("rank"))
    return kept.withColumn("n", first).filter("n = 1").select("row.*")
