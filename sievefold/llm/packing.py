"""Sequence packing as a cutting-stock problem, solved by column generation."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievefold.llm.shared import Scratch, keep_columns, library_tokenizer, slices


@dataclass(frozen=True)
class PackingRules:
    """``size`` tokens a sequence; lengths count in steps of ``grain`` for the plan.

    The plan sees at most size / grain length classes whatever the corpus, so
    the linear program, its patterns and the rounded remainder are bounded.
    """

    size: int = 2048
    grain: int = 8
    end_id: int = 1
    tokenizer: str = "byte_bpe_50k.json"
    max_columns: int = 1200
    rank_rows: int = 200_000
    batch_bytes: int = 4 << 20
    cache_words: int = 200_000


class ChunkTokenizer:
    """Token ids through the tokenizers library, each distinct word of a batch once.

    A word is what lies between single blanks; it is encoded with the blank before it.
    Byte-level pre-tokenization always starts anew at a blank between two
    characters that aren't white space, so ids of words join to ids of the text.
    Texts with other white space beside a blank, or special strings, go whole.
    """

    def __init__(self, path: str, bound: int):
        self.tokenizer = library_tokenizer(path)
        self.bound = bound
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        space = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
        quoted = "|".join("".join("\\" + c if not c.isalnum() else c for c in t) for t in specials)
        self.odd = f"{space}\\x20|\\x20{space}|^\\x20|\\x20$" + (f"|{quoted}" if quoted else "")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: pa.Array, some: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, each with a blank before it; ids of each), for words that hold no blank.

        Some at a time are encoded as one text; a byte-level id stands for a known number
        of bytes, so the places of the blanks tell which ids are a word's own. Longer
        texts cost the library more for each word.
        """
        cuts = pa.array(np.r_[np.arange(0, len(words), some), len(words)].astype(np.int32))
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for joined in pc.binary_join(pa.ListArray.from_arrays(cuts, words), " ").to_pylist() if len(words) else []:
            text = " " + joined
            own = np.array(self.encode([text])[0], np.uint32)
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.r_[np.flatnonzero(raw == 0x20)[1:], len(raw)]
            ids.append(own)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.bytes[own]), ends, "left") + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def inner(self, words: pa.Array, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's start among them, how many) of distinct words that follow a blank.

        Words used twice or more in a batch are remembered, up to ``bound``; most others never come again.
        """
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        ids, counts = self.encode_words(fresh)
        begin = np.cumsum(counts) - counts
        starts, lengths = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        held = at >= 0
        starts[held], lengths[held] = self.starts[at[held]], self.lengths[at[held]]
        starts[new], lengths[new] = begin + len(self.ids), counts
        every = np.r_[self.ids, ids]
        again = np.flatnonzero(uses[new] > 1)[: max(0, self.bound - len(self.known))]
        if len(again):
            kept = counts[again]
            self.starts = np.r_[self.starts, np.cumsum(kept) - kept + len(self.ids)]
            self.lengths = np.r_[self.lengths, kept]
            self.ids = np.r_[self.ids, ids[_ranges(begin[again], kept)]]
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(again))])
        return every, starts, lengths

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end_id``; ids of each text)."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        parts = pc.split_pattern(plain, " ")
        parents = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(parts).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        first = np.r_[True, parents[1:] != parents[:-1]][: len(parents)]
        # words at the start of a text have no blank before them
        uses = np.bincount(codes[~first], minlength=len(coded.dictionary))
        used = np.flatnonzero(uses)
        inner_ids, at, size = self.inner(coded.dictionary.take(pa.array(used)), uses[used])
        heads = np.unique(codes[first])
        own = self.encode(coded.dictionary.take(pa.array(heads)).to_pylist())
        own_sizes = np.array([len(x) for x in own], np.int64)
        all_ids = np.r_[inner_ids, np.array([i for x in own for i in x], np.uint32)]
        start, length = np.zeros((2, len(uses)), np.int64), np.zeros((2, len(uses)), np.int64)
        start[0, used], length[0, used] = at, size
        start[1, heads], length[1, heads] = np.cumsum(own_sizes) - own_sizes + len(inner_ids), own_sizes
        side = first.astype(np.int64)
        lengths = length[side, codes]
        ids, counts = all_ids[_ranges(start[side, codes], lengths)], np.bincount(parents, lengths, n).astype(np.int64)
        rows = np.flatnonzero(odd)
        whole = self.encode(texts.take(pa.array(rows)).to_pylist()) if len(rows) else []
        at = np.cumsum(counts)
        extra, owner = [], []
        for row, mine in zip(rows.tolist(), whole, strict=True):
            counts[row] = len(mine)
            extra += [*mine, end_id]
            owner += [at[row]] * (len(mine) + 1)
        closing = np.flatnonzero(~odd)
        where = np.r_[np.array(owner, np.int64), at[closing]]
        values = np.r_[np.array(extra, np.uint32), np.full(len(closing), end_id, np.uint32)]
        # rows in order at one place: an odd row has no ids of its own in the joined array
        row_of = np.r_[np.repeat(rows, [len(w) + 1 for w in whole]).astype(np.int64), closing]
        by = np.lexsort((row_of, where))
        return np.insert(ids, where[by], values[by]), counts + 1


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges start, start + 1, ... of the given lengths, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, bound: int) -> ChunkTokenizer:
    return ChunkTokenizer(path, bound)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: PackingRules = PackingRules(), path: str | None = None) -> DataFrame:
    """(id, n, ids) of each row: ids as little-endian 32-bit words, the end id included."""
    inner = keep_columns(docs, {"id": id_col, "text": text_col})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", rules.batch_bytes):
            held = tokenizer(path or public_tokenizers.path(rules.tokenizer), rules.cache_words)
            ids, counts = held.texts(pc.fill_null(part.column("text"), ""), rules.end_id)
            ends = np.r_[0, np.cumsum(counts) * 4].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts), packed], names=["id", "n", "ids"])

    return inner.mapInArrow(run, f"id {inner.schema['id'].dataType.simpleString()}, n long, ids binary")


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: most value within the capacity."""
    worth, item = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    worth[sizes], item[sizes] = values, np.arange(len(sizes))
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        total = best[c - 1 :: -1] + worth[1 : c + 1]
        k = int(total.argmax())
        if total[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = total[k], item[k + 1]
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int, tolerance: float = 0.002) -> list[tuple[np.ndarray, int]]:
    """Patterns (items of each size, sizes ascending) and how often each is used; all demand is met exactly.

    The linear program over patterns is solved by the revised simplex method;
    knapsack dynamic programming prices new columns, until the cost is within
    ``tolerance`` of the lower bound that the prices give. Uses are rounded down; what
    is left over, less than a pattern for each column, is filled by bounded knapsacks, longest first.
    """
    m, at = len(sizes), {int(s): k for k, s in enumerate(sizes)}
    unit = np.eye(m, dtype=np.int64)
    columns, x = [], np.zeros(m)
    # first basis: of two sizes that fill a sequence the rarer one is paired, the other's excess goes alone
    for k, s in enumerate(sizes.tolist()):
        other = at.get(capacity - s)
        if other is None or other == k or (demand[k], k) > (demand[other], other):
            columns.append(unit[k] * (capacity // s))
            x[k] = (demand[k] - (demand[other] if other not in (None, k) else 0)) / (capacity // s)
        else:
            columns.append(unit[k] + unit[other])
            x[k] = demand[k]
    basis, costs = np.array(columns, float).T.copy(), np.ones(m)
    inverse = np.diag(1 / np.diag(basis))
    for k in range(m):  # the partner of a pair is never in a pair's column itself
        other = at.get(capacity - int(sizes[k]))
        if other not in (None, k) and columns[k][other]:
            inverse[other, k] = -inverse[other, other]
    for _ in range(max_columns):
        duals = costs @ inverse
        surplus = int(duals.argmin())
        value, pattern = best_pattern(np.maximum(duals, 0), sizes, capacity)
        if float(costs @ x) <= (1 + tolerance) * float(np.maximum(duals, 0) @ demand) / max(value, 1.0):
            break  # the duals over the best pattern's value bound the program from below
        if value > 1 + 1e-7 and value - 1 >= -duals[surplus]:
            entering, cost = pattern, 1.0
        elif duals[surplus] < -1e-7:
            entering, cost = -np.eye(m, dtype=np.int64)[surplus], 0.0
        else:
            break
        along = inverse @ entering
        ratio = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out], costs[out], basis[:, out] = entering, cost, entering
        x = x - ratio[out] * along
        x[out] = ratio[out]
        row = inverse[out] / along[out]
        inverse -= np.outer(along, row)
        inverse[out] = row
        x = np.maximum(x, 0)
    left = demand.astype(np.int64).copy()
    plan = []
    for column, cost, uses in sorted(zip(columns, costs, np.floor(x + 1e-6), strict=True), key=lambda p: -p[2]):
        if cost:
            fits = min([int(uses), *(left[column > 0] // column[column > 0]).tolist()])
            if fits > 0:
                plan.append((column.copy(), fits))
                left -= column * fits
    while left.any():
        pattern = fullest(sizes, left, capacity)
        uses = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, uses))
        left -= pattern * uses
    return plan


def fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The largest size left and, of what else is left, what fills a sequence most, large sizes before small ones.

    Reachable sums are the bits of one integer; a size's items are taken in powers of two.
    """
    counts = np.zeros(len(sizes), np.int64)
    first = int(np.flatnonzero(left)[-1])
    counts[first], room = 1, capacity - int(sizes[first])
    reach, steps = 1, []
    for k in range(first, -1, -1):
        size = int(sizes[k])
        items, take = min(int(left[k] - counts[k]), room // size), 1
        while items > 0:
            take = min(take, items)
            steps.append((k, take, reach))
            reach |= (reach << (take * size)) & ((2 << room) - 1)
            items, take = items - take, take * 2
    at = reach.bit_length() - 1
    for k, take, before in reversed(steps):
        if not before >> at & 1:
            counts[k] += take
            at -= take * int(sizes[k])
    return counts


@dataclass(frozen=True)
class Slots:
    """Where the pieces of each class go, by their rank in it; all arrays are bounded."""

    key: np.ndarray
    low: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    slot: np.ndarray

    def find(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (classes.astype(np.int64) << 44) + ranks, "right") - 1
        turn, within = np.divmod(ranks - self.low[k], self.each[k])
        return self.sequence[k] + turn, self.slot[k] + within


def slots(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> Slots:
    used, rows, sequence = np.zeros(len(sizes), np.int64), [], 0
    for pattern, uses in plan:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[k])
            rows.append(((int(sizes[k]) << 44) + int(used[k]), int(used[k]), each, sequence, slot))
            used[k] += each * uses
            slot += each
        sequence += uses
    return Slots(*np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def pack(tokens: DataFrame, rules: PackingRules = PackingRules(), scratch: Scratch | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece.

    ``tokens`` is a written table from ``tokenize``. A document longer than a
    sequence is cut at multiples of ``size``; only piece lengths are planned.
    The histogram of length classes goes to the driver (size / grain rows at
    most), and the plan back as arrays bounded likewise. Pieces are ranked in
    their class by hash buckets of about ``rank_rows`` rows each, so one length that
    very many pieces share is spread over tasks; ids themselves are never
    shuffled. Ties in a class are broken by length, id and start.
    """
    pieces = tokens.select("id", "n", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rules.size).cast("long"))).alias("start"))
    pieces = pieces.withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(rules.size)))
    classed = pieces.withColumn("class", F.ceil(F.col("length") / rules.grain).cast("long"))
    histogram = sorted((int(r["class"]), int(r["count"])) for r in classed.groupBy("class").count().collect())
    sizes = np.array([c for c, _ in histogram], np.int64)
    demand = np.array([n for _, n in histogram], np.int64)
    plan = solve(sizes, demand, rules.size // rules.grain, rules.max_columns) if len(sizes) else []
    where = slots(sizes, plan)
    buckets = int(max(16, -(-int(demand.sum()) // rules.rank_rows)))

    cut = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    scratch = scratch or Scratch(tokens.sparkSession)
    small = scratch.table(classed.select("id", "start", "length", "n", "class", F.crc32(cut).alias("crc"), F.pmod(F.xxhash64("id", "start", "n", F.crc32(cut)), F.lit(buckets)).alias("bucket")), "pieces")
    counts = small.groupBy("class", "bucket").count()
    before = counts.select("class", "bucket", (F.sum("count").over(Window.partitionBy("class").orderBy("bucket")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "bucket").orderBy(F.desc("length"), "id", "start", "crc"))
    ranked = small.withColumn("within", within).join(before, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                sequence, slot = where.find(part.column("class").to_numpy(), part.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "start", "length", "crc", "n")), pa.array(sequence), pa.array(slot)], names=["id", "start", "length", "crc", "n", "sequence_id", "slot"])

    kind = tokens.schema["id"].dataType.simpleString()
    placed = ranked.select("id", "start", "length", "crc", "n", "class", "rank").mapInArrow(run, f"id {kind}, start long, length long, crc long, n long, sequence_id long, slot long")
    gapless = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.select("id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", gapless.alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: PackingRules = PackingRules(), path: str | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens, pieces): the written token table and the plan of pieces.

    A null or empty text is the end id alone; repeated rows are packed each;
    null ids are kept; an empty table gives empty results; other columns are
    ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    tokens = scratch.table(tokenize(docs, id_col, text_col, rules, path), "tokens")
    return tokens, pack(tokens, rules, scratch)


def sequences(tokens: DataFrame, pieces: DataFrame, rules: PackingRules = PackingRules()) -> DataFrame:
    """(sequence_id, ids, n): the packed ids, without padding. Ids must be unique and not null."""
    cut = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    parts = pieces.join(tokens.select("id", "ids"), "id").select("sequence_id", "offset", "length", cut.alias("part"))
    joined = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"), F.sum("length").alias("n"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["part"]))
    return joined.select("sequence_id", whole.alias("ids"), "n")
