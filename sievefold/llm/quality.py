"""Quality rules: repetition found with suffix arrays over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.llm.shared import WORD, bound_batches, keep_columns, slices, split_words, with_text

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class QualityRules:
    """Limits. Repeats are maximal repeated word sequences.

    The base rule counts words in repeats of ``min_repeat`` words or more. The
    method's verdict looks at long repeats, of ``long_repeat`` words or more, which are rarer in
    good text: the fraction they cover, and the longest.
    """

    min_words: int = 20
    min_repeat: int = 8
    max_repeat_percent: int = 30
    long_repeat: int = 20
    max_covered: float = 0.20
    max_longest: int = 100
    batch_bytes: int = 4 << 20


def suffix_array(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over all rows at once, and the LCP with the suffix before.

    ``codes`` are word numbers, ``rows`` (ascending) the document of each. A
    suffix ends with its document. Prefix doubling: ranks by the first 1, 2,
    4, ... words; a suffix whose rank is unique leaves the next rounds. The
    ranks of every level are kept, and an LCP is read off them from the
    highest level down. Suffixes of different documents share no prefix.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = rows.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    del key
    start = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[order] = start
    levels = [rank]
    pairs = np.flatnonzero(~head).astype(np.int32)  # places in the suffix array that share a word with the place before
    size = np.bincount(start, minlength=n)
    place = np.flatnonzero(size[start] > 1).astype(np.int32)  # places still shared
    del size, start
    active = order[place]
    end = np.searchsorted(rows, rows, "right").astype(np.int32)
    sa, step = order, 1
    while len(active):
        last = levels[-1]
        beyond = active + np.int32(step)
        second = np.where(beyond < end[active], last[np.minimum(beyond, np.int32(n - 1))] + np.int32(1), np.int32(0))
        first = last[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        head = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        start = np.maximum.accumulate(np.where(head, place, np.int32(0)))
        sa[place] = active
        rank = last.copy()
        rank[active] = start
        levels.append(rank)
        size = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] > 1
        active, place, step = active[size], place[size], step * 2
    lcp = np.zeros(n, np.int64)
    a, b = sa[pairs - 1].copy(), sa[pairs].copy()
    end_a, end_b, got = end[a], end[b], np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        width, rank = 1 << level, levels[level]
        inside = (a + width <= end_a) & (b + width <= end_b)
        same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
        a, b, got = a + width * same, b + width * same, got + width * same
    lcp[pairs] = got
    return sa, lcp


def repeats(codes: np.ndarray, rows: np.ndarray, min_repeat: int, n_rows: int, long_repeat: int | None = None) -> dict[str, np.ndarray]:
    """Per row: words covered by repeats and by long ones, the longest repeat, number of maximal repeats.

    The longest LCP interval above a suffix is the longest repeat that starts
    there; the union of all these spans is what repeats cover.
    """
    n = len(codes)
    sa, lcp = suffix_array(codes, rows)
    after = np.r_[lcp[1:], 0] if n else lcp
    long = np.zeros(n, np.int64)
    long[sa] = np.maximum(lcp, after)

    def covered(least: int) -> np.ndarray:
        starts = np.flatnonzero(long >= least)
        delta = np.zeros(n + 1, np.int64)
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + long[starts], -1)
        return np.bincount(rows, np.cumsum(delta[:n]) > 0, n_rows).astype(np.int64)

    longest = np.zeros(n_rows, np.int64)
    np.maximum.at(longest, rows, long)
    # a repeat that can't be extended to the left: the one before isn't a longer repeat by one
    before = np.r_[0, long[:-1]] if n else long
    first = np.r_[True, rows[1:] != rows[:-1]] if n else long > 0
    maximal = (long >= min_repeat) & (first | (before != long + 1))
    return {
        "covered": covered(min_repeat),
        "long": covered(long_repeat or min_repeat),
        "longest": longest,
        "maximal": np.bincount(rows, maximal, n_rows).astype(np.int64),
    }


def _measure(batch: pa.RecordBatch, rules: QualityRules) -> pa.RecordBatch:
    n = batch.num_rows
    texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
    words, parents = split_words(texts)
    rows = parents.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    found = repeats(codes, rows, rules.min_repeat, n, rules.long_repeat)
    n_words = np.bincount(rows, minlength=n).astype(np.int64)
    chars = np.bincount(rows, lengths[codes] if len(codes) else None, n).astype(np.int64)

    lines = pc.split_pattern(texts, "\n")
    line_rows = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line = pc.list_flatten(lines).dictionary_encode()
    worded = pc.match_substring_regex(line.dictionary, WORD).to_numpy(zero_copy_only=False)
    line_codes = line.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = worded[line_codes]
    line_rows, line_codes = line_rows[keep], line_codes[keep]
    distinct = np.unique(line_rows * max(1, len(worded)) + line_codes)
    n_dup = np.bincount(line_rows, minlength=n) - np.bincount(distinct // max(1, len(worded)), minlength=n)

    failed = (n_words < rules.min_words) | (100 * found["covered"] > rules.max_repeat_percent * n_words)
    share = found["long"] / np.maximum(n_words, 1)
    kept = ~failed & (share <= rules.max_covered) & (found["longest"] <= rules.max_longest)
    out = {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64()),
        "n_dup_lines": n_dup.astype(np.int64),
        "n_repeat_words": found["covered"],
        "base_failed": failed,
        "kept": kept,
        "covered_fraction": share,
        "longest_repeat": found["longest"],
        "n_maximal_repeats": found["maximal"],
    }
    others = [c for c in batch.schema.names if c != "text"]
    names = [*others, *(["text"] if "text" in batch.schema.names else []), *out]
    arrays = [batch.column(c) for c in names[: len(names) - len(out)]] + [pa.array(v) if not isinstance(v, pa.Array) else v for v in out.values()]
    return pa.RecordBatch.from_arrays(arrays, names=names)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long, n_maximal_repeats long"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules(), with_text: bool = False) -> DataFrame:
    """One row of measures and the verdict ``kept`` for each document.

    Each batch of documents gets one suffix array over its words; documents
    are never compared with each other, so there is no shuffle. A null or
    empty text has no words, fails the base rule and isn't kept. Repeated rows
    and null ids are each judged alone. Other columns are ignored, so their
    names can't clash. An empty table gives an empty result. One document is
    the least unit of memory, about 100 bytes a word.
    """
    inner = keep_columns(docs, {"id": id_col, "text": text_col})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", rules.batch_bytes):
            got = _measure(part, rules)
            yield got if with_text else got.select([c for c in got.schema.names if c != "text"])

    kind = inner.schema["id"].dataType.simpleString()
    out = inner.mapInArrow(run, f"id {kind}, " + ("text string, " if with_text else "") + MEASURES)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with all their columns, whatever their names.

    A null or empty text has no words and goes. Repeated rows and null ids are each judged
    alone; an empty table gives an empty result.
    """
    inner = bound_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(with_text(batches, place), "text", rules.batch_bytes):
            yield part.select(["row"]).filter(_measure(part.select(["text"]), rules).column("kept"))

    kept = inner.mapInArrow(run, inner.schema)
    return kept.select("row.*")
