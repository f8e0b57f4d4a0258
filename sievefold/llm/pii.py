"""Personal data: patterns propose spans, checksums confirm, context scores.

Only SQL functions run here, so all work stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievefold.llm.shared import keep_columns, let

#: The base kinds in the order of the digest, then the kinds the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE = KINDS[:4]

# Patterns are written so that matching takes linear time and no recursion on
# long runs: possessive repeats, and no start inside a run that already failed.
# \G lets a match start right after the one before, within the same run. A dot
# inside a domain and a single blank or hyphen inside a number first become a
# mark of the same length, so that a repeat of groups is a run of one class.
MARK = "\uffff"
JOINTS = {"email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "card": r"(?<=[0-9])[\x20-](?=[0-9])"}
PATTERNS = {
    "email": f"(?:\\G|(?<![A-Za-z0-9._%+{MARK}-]))[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": f"[0-9{MARK}]{{2,}}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+])(?<![0-9][\x20.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![\x20.-]?[0-9])",
}


#: A cheap look that a text must pass before a kind is sought in it.
SIGNS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "phone": r"\+",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}\x20?[A-Z0-9]",
    "local_phone": r"[0-9]{2}\)?[\x20.-][0-9]{3}",
}


@dataclass(frozen=True)
class PiiRules:
    """Scores: a kind's own, and what a whole context word near it adds.

    An added kind needs ``added_from``: a number that its checksum confirms has it
    alone, a telephone number without a country's code only beside a context word.
    """

    scores: dict = field(default_factory=lambda: {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "local_phone": 0.6})
    context: dict = field(
        default_factory=lambda: {
            "email": ("mail", "email", "e-mail", "contact", "write"),
            "ip": ("ip", "host", "address", "server"),
            "card": ("card", "visa", "credit", "payment"),
            "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
            "iban": ("iban", "account", "bank"),
            "local_phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
        }
    )
    bonus: float = 0.2
    reach: int = 40
    added_from: float = 0.8
    block: int = 1024


def _located(text: Column, pattern: str, block: int) -> Column:
    """Array of (start, hit) of all matches, in code points, by what lies between them.

    Starts are running sums of lengths, taken in blocks of matches and over
    the blocks' totals, so that no array grows with every match of a text.
    """
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    pairs = let(both, lambda b: F.zip_with(F.slice(b["gaps"], F.lit(1), F.size(b["hits"])), b["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))))
    cut = lambda p: F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / block).cast("int")), lambda k: F.slice(p, k * block + 1, F.lit(block))))
    none = F.array().cast("array<int>")
    step = lambda x: x["gap"] + F.length(x["hit"])

    def starts(parts: Column) -> Column:
        """Where each block starts."""
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + step(x)))
        run = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list"))
        return F.aggregate(totals, F.struct(F.lit(0).alias("at"), none.alias("list")), run, lambda acc: acc["list"])

    def within(p: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("found"))
        add = lambda acc, x: F.struct((acc["at"] + step(x)).alias("at"), F.concat(acc["found"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["hit"].alias("hit")))).alias("found"))
        return F.aggregate(p, zero, add, lambda acc: acc["found"])

    located = let(let(pairs, cut), lambda parts: F.flatten(F.zip_with(parts, starts(parts), within)))
    return F.coalesce(located, F.array().cast("array<struct<start:int,hit:string>>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass Luhn's check; the input is digits only."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the first four characters, moved to the end, leave 1 modulo 97; A is 10."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    places = F.sequence(F.lit(1), F.length(moved))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97

    return F.aggregate(places, F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    """The part of a match that its kind's test confirms; null if none."""
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.when(F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)), hit)
    if kind == "card":
        d = _digits(hit)
        return F.when(F.length(d).between(13, 19) & luhn(d), hit)
    if kind == "phone":
        return F.when(F.length(_digits(hit)).between(9, 15), hit)
    if kind == "iban":  # printed in groups, its last group may be a word that follows
        less = F.regexp_replace(hit, r"\x20[A-Z0-9]+$", "")
        plain = lambda h: F.translate(h, " ", "")
        fits = lambda h: F.length(plain(h)).between(15, 34) & mod97(plain(h))
        return F.when(fits(hit), hit).when(fits(less), less)
    return hit


def _spans(text: Column, kind: str, rules: PiiRules) -> Column:
    """Array of confirmed spans of one kind; empty if a cheap look finds no sign of it."""
    searched = F.regexp_replace(F.translate(text, MARK, "!"), JOINTS[kind], MARK) if kind in JOINTS else text
    near = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(rules.context[kind]) + r")(?![\p{L}\p{N}])"
    width = F.lit(rules.block)

    def piece(blocks: Column, start: Column, n: Column) -> Column:
        """A short stretch of the text, from the one or two of its blocks that hold it."""
        k = F.floor(start / width).cast("int")
        return F.substring(F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit(""))), start - k * width + 1, n)

    def span(x: Column, blocks: Column) -> Column:
        reach, end = F.lit(rules.reach + 1), x["start"] + F.length(x["hit"])
        left = F.greatest(x["start"] - reach, F.lit(0))
        around = F.concat(piece(blocks, left, x["start"] - left), F.lit("\n"), piece(blocks, end, reach))
        score = F.lit(float(rules.scores[kind])) + F.when(around.rlike(near), F.lit(float(rules.bonus))).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("rank"),
            x["start"].alias("start"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            F.round(F.least(score, F.lit(1.0)), 4).alias("score"),
        )

    parts = F.transform(_located(searched, PATTERNS[kind], rules.block), lambda x: F.struct(x["start"].alias("start"), _confirmed(kind, x["hit"]).alias("hit")))
    hits = F.filter(parts, lambda x: x["hit"].isNotNull())
    # a text is cut into blocks once, as looking into a long one from its start for each match would cost its length
    cut = lambda h: F.when(F.size(h) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{rules.block}}}"), F.lit(0)))
    found = let(hits, lambda h: let(F.struct(h.alias("h"), cut(h).alias("blocks")), lambda b: F.transform(b["h"], lambda x: span(x, b["blocks"]))))
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= rules.added_from)
    empty = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string,score:double>>")
    return F.when(text.rlike(SIGNS[kind]), found).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: PiiRules = PiiRules()) -> DataFrame:
    """``spans``: array of (rank, start, end, kind, score) of each document.

    Offsets are code points, end exclusive, ordered by kind as in ``KINDS``
    and then start. Base kinds stay whatever their score; the added kinds, bank account
    numbers with a checksum and telephone numbers without a country's code, need
    ``added_from``. One narrow pass: nothing is shuffled, so ties,
    repeated rows and null ids are each judged alone; a null text counts as
    empty, an empty table gives an empty result, and other columns are ignored.
    """
    inner = keep_columns(docs, {"id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        inner = inner.withColumn(f"s_{kind}", _spans(F.col("text"), kind, rules))
    return inner.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.concat(*[F.col(f"s_{k}") for k in KINDS]).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame, kinds: Sequence[str] = BASE) -> DataFrame:
    """Counts by kind, a digest of the base spans, all spans, and their scores in the same order.

    A row for each row of ``find_pii``, null ids and repeated rows included; without spans the strings are empty.
    """
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def of_kind(rank: int) -> Column:  # a second parameter of the lambda would be the element's place
        return F.filter("spans", lambda s: s["rank"] == rank)

    counts = [F.size(of_kind(KINDS.index(k))).cast("long").alias(f"n_{k}") for k in kinds]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))
