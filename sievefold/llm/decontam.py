"""Benchmark decontamination with spaced seeds. SQL functions only.

A mask such as ``1101`` hashes the words under its ones and ignores those
under its zeros, so a window still hits where an ignored word was replaced.
Every window of every benchmark item is hashed; documents are hashed at every
``stride``-th word, which still meets each shared stretch of at least
``len(mask) + stride - 1`` words. A hit names an alignment of an item with a
document; the words of both are then compared along it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievefold.llm.shared import Scratch, keep_columns, let, row_keys


@dataclass(frozen=True)
class DecontamRules:
    """A mask of weight 8 and two of weight 7, the score a shared stretch needs, and what may be broadcast.

    The masks were chosen by search for the least recall over stretches of 15 to 60 words with 10 to 30 % of words replaced.

    A stretch scores 1 for an equal word and ``-penalty`` for another; the
    best stretch along an alignment counts. Items of fewer words than the score
    need all of them; those shorter than the shortest mask are sought as a whole.
    """

    masks: tuple[str, ...] = ("1101110111", "1110100111", "1110010001011")
    stride: int = 1
    min_score: int = 10
    penalty: int = 1
    broadcast_rows: int = 1_000_000
    broadcast_words: int = 4_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(words: DataFrame, shapes: list[tuple[int, int, list[int]]], stride: int) -> DataFrame:
    """(id, k1, k2, seed, at) of each window of each shape: a tag, its length, the places that count.

    Words are hashed once a text; each place is then a row that carries the text's hashes along, so
    that seeds are taken by generated code and not inside a lambda.
    """
    hashed = words.select("id", "k1", "k2", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    last = F.size("h") - min(length for _, length, _ in shapes)
    # the outer forms keep the optimizer from testing each array's size before, which would build it twice
    placed = hashed.select("id", "k1", "k2", "h", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))).alias("at"))

    def seed(tag: int, length: int, places: list[int]) -> Column:
        return F.when(F.col("at") + length <= F.size("h"), F.xxhash64(F.lit(tag), *[F.get("h", F.col("at") + k) for k in places]))

    each = placed.select("id", "k1", "k2", "at", F.explode_outer(F.array(*[seed(*shape) for shape in shapes])).alias("seed"))
    return each.filter(F.col("seed").isNotNull()).select("id", "k1", "k2", "seed", "at")


def seeds(words: DataFrame, rules: DecontamRules, stride: int) -> DataFrame:
    """(id, k1, k2, seed, at) of each window under each mask. ``words`` has id, k1, k2 and words."""
    return _windows(words, [(which, len(mask), [k for k, c in enumerate(mask) if c == "1"]) for which, mask in enumerate(rules.masks)], stride)


def whole_seeds(words: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, k1, k2, seed, at) of each run of as many words as one of ``lengths`` says."""
    return _windows(words, [(-n, n, list(range(n))) for n in lengths], 1)


def best_stretch(doc: Column, item: Column, shift: Column, penalty: int) -> Column:
    """Best-scoring stretch of the item along one alignment: (score, matched words)."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        run = F.when(F.get(doc, i + shift) == F.get(item, i), acc["run"] + 1).otherwise(F.greatest(acc["run"] - penalty, F.lit(0)))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), zero, step, lambda acc: acc["best"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rules: DecontamRules = DecontamRules(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, k1, k2, item_id, score): document and item pairs that share a stretch of words.

    k1 and k2 tell documents apart by id and text. Items are told apart by
    their distinct word sequences while hashing, so
    repeated items add no hits; the result names each item id. Hits
    are found in one narrow pass against the seeds, which are broadcast only if
    counted to be at most ``broadcast_rows``; else both sides are shuffled on
    the seed. Hits are written; the keys of the documents that have one are broadcast
    under the same bound, and then only the words of these documents move, else
    all texts are shuffled once. Items that were hit are broadcast only if they are counted to have
    ``broadcast_words`` words at most. Items shorter than the shortest
    mask are hashed as a whole and met with all runs of their length in the documents,
    of which the first in a document is compared; without such items nothing is
    added. Null and empty texts and items share nothing; repeated rows give one pair;
    null ids are kept; an empty table on either side gives an empty result;
    other columns are ignored. The result reads tables in ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    k1, k2 = row_keys("id", "text")
    own = keep_columns(docs, {"id": id_col, "text": text_col}).withColumns({"k1": k1, "k2": k2})
    doc_words = own.select("id", "k1", "k2", words_of(F.col("text")).alias("words"))
    items = keep_columns(benchmark, {"item": item_col, "text": item_text_col}).select("item", words_of(F.col("text")).alias("words")).distinct()
    nothing = F.lit(0).cast("long")
    sequences = items.select("words", F.xxhash64("words").alias("id"), nothing.alias("k1"), nothing.alias("k2")).dropDuplicates(["words"]).filter(F.size("words") > 0)
    known = seeds(sequences.select("id", "k1", "k2", "words"), rules, 1).select("seed", F.col("id").alias("seq"), F.col("at").alias("item_at")).distinct()

    def met(probes: DataFrame, targets: DataFrame) -> DataFrame:
        small = targets.count() <= rules.broadcast_rows
        return probes.join(F.broadcast(targets) if small else targets.hint("shuffle_hash"), "seed")

    hits = met(seeds(doc_words, rules, rules.stride), known)
    aligned = hits.select("id", "k1", "k2", "seq", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    brief = sequences.filter(F.size("words") < min(map(len, rules.masks)))
    lengths = sorted(r["n"] for r in brief.select(F.size("words").alias("n")).distinct().collect())  # fewer than a mask has places
    if lengths:
        wholes = None
        for n in lengths:
            named = F.xxhash64(F.lit(-n), *[F.xxhash64(F.get("words", F.lit(k))) for k in range(n)])
            one = brief.filter(F.size("words") == n).select(named.alias("seed"), F.col("id").alias("seq"))
            wholes = one if wholes is None else wholes.unionAll(one)
        runs = met(whole_seeds(doc_words, lengths), wholes)
        aligned = aligned.unionByName(runs.groupBy("id", "k1", "k2", "seq").agg(F.min("at").alias("shift")))
    aligned = scratch.table(aligned, "aligned")

    keys = aligned.select("k1", "k2").distinct()
    few = keys.count() <= rules.broadcast_rows
    hit_words = own.join(F.broadcast(keys) if few else keys, ["k1", "k2"]).select("k1", "k2", words_of(F.col("text")).alias("words"))
    hit_items = sequences.select(F.col("id").alias("seq"), F.col("words").alias("item_words")).join(aligned.select("seq").distinct(), "seq", "left_semi")
    brought = hit_items.agg(F.coalesce(F.sum(F.size("item_words")), nothing)).first()[0] <= rules.broadcast_words
    with_item = aligned.join(F.broadcast(hit_items) if brought else hit_items, "seq")
    both = with_item.join(hit_words, ["k1", "k2"])
    scored = both.select("id", "k1", "k2", "seq", F.size("item_words").alias("n"), let(F.struct("words", "item_words"), lambda x: best_stretch(x["words"], x["item_words"], F.col("shift"), rules.penalty)).alias("score"))
    best = scored.groupBy("id", "k1", "k2", "seq").agg(F.max("score").alias("score"), F.first("n").alias("n")).filter(F.col("score") >= F.least(F.lit(rules.min_score), F.col("n")))
    named = best.join(items.select("item", F.xxhash64("words").alias("seq")), "seq")
    return named.select(F.col("id").alias(id_col), "k1", "k2", F.col("item").alias(item_col), "score")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: DecontamRules = DecontamRules(), scratch: Scratch | None = None) -> DataFrame:
    """The documents that share no stretch with an item, with all their columns, whatever their names.

    Null and empty texts stay; of rows equal in id and text all go or all stay; a null id is
    no reason for either; with no documents or no items nothing goes. The keys of those
    that go are written and broadcast if counted to be at most ``broadcast_rows``, else joined.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    bad = scratch.table(find_leaks(docs, benchmark, id_col, text_col, rules=rules, scratch=scratch).select(F.col("k1").alias("bad_1"), F.col("k2").alias("bad_2")).distinct(), "bad")
    k1, k2 = row_keys(f"`{id_col}`", f"`{text_col}`")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("bad_1"), k2.alias("bad_2"))
    few = bad.count() <= rules.broadcast_rows
    return keyed.join(F.broadcast(bad) if few else bad, ["bad_1", "bad_2"], "left_anti").select("row.*")
