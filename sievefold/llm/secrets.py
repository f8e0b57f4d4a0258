"""Secret scans: patterns, and strings that a primed compressor finds novel."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.llm.shared import bound_batches, keep_columns, slices, with_text

KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is too short has no longer one inside
HEX = re.compile(r"[0-9a-f]{24,}")
# '=' ends a run, so the value of KEY=value is one; it is padding only where nothing of the run follows.
START = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16}")
REST = re.compile(r"[A-Za-z0-9+/_.-]{16,}(?:={1,2}(?![A-Za-z0-9+/_.=-]))?")
CONTEXT = re.compile(r"(?ai:pass(?:word|wd|phrase)|secret|token|api_?key|auth|bearer|credential|private_?key|access_?key|signature|session)")

# A wider and cheaper look, by a linear-time matcher, at which texts need the patterns.
ANY = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "novel": r"(?i:pass(word|wd|phrase)|secret|token|api_?key|auth|bearer|credential|private_?key|access_?key|signature|session)",
}

#: Identifiers and phrases that code and its settings are full of, as the dictionary's text.
IDENTIFIERS = """
def return self import from class function const let var public static void string int bool true false null none
password passwd secret token api_key apikey auth authorization bearer credential private_key access_key session signature
client_id client_secret user username email config settings environment variable default example changeme placeholder
localhost http https www com org net index html json yaml xml utf-8 application content type length date time version
get set put post delete update insert select where order group limit offset value key name path file size data result
getElementById addEventListener toString valueOf hasOwnProperty prototype constructor undefined instanceof typeof
customer account users archive release notes final build machine number reset request response service server backup report
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1111111111 xxxxxxxxxxxxxxxx aaaaaaaaaaaaaaaa
"""

#: Parts of a name: a word of one case or with a capital, between other characters.
PART = re.compile(r"(?<![A-Za-z])(?:[A-Z]?[a-z]{3,12}|[A-Z]{3,12})(?![a-z])|(?<=[a-z])(?:[A-Z][a-z]{2,12}|By|Id|Of|To|In|On|Is)(?![a-z])")
#: Right after a sign of assignment, a blank and a quote.
ASSIGNED = re.compile(r"[:=]\x20?[\"']?$")
#: Bits of a character that is one of ten digits, 26 or 52 letters; of a letter in a word of prose.
DIGIT, ONE_CASE, TWO_CASES, PROSE = 3.32, 4.7, 5.7, 2.3


@dataclass(frozen=True)
class SecretRules:
    """A string is novel if it holds ``min_bits`` in all and ``min_rate`` for each character that can't be told from what is known.

    ``identifiers`` is the dictionary's text; a caller may add those of its own code base.
    """

    reach: int = 64
    around: int = 256
    min_bits: float = 64.0
    min_rate: float = 2.6
    level: int = 3
    identifiers: str = IDENTIFIERS
    batch_bytes: int = 4 << 20


def most_bits(value: str) -> float:
    """What a string can tell at most, by the kinds of its characters: letters in words tell less, marks between them nothing."""
    words = sum(len(w) for w in PART.findall(value))
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value) - words
    mixed = re.search("[a-z]", value) and re.search("[A-Z]", value)
    return digits * DIGIT + words * PROSE + letters * (TWO_CASES if mixed else ONE_CASE)


class Novelty:
    """Marginal bytes of a string after its surroundings and a dictionary of identifiers."""

    def __init__(self, rules: SecretRules):
        words = zstandard.ZstdCompressionDict(rules.identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.coder = zstandard.ZstdCompressor(level=rules.level, dict_data=words, write_content_size=False)
        self.random: dict[int, int] = {}

    def _more(self, before: bytes, value: bytes) -> int:
        return len(self.coder.compress(before + value)) - len(self.coder.compress(before))

    def _random(self, n: int) -> int:
        """Marginal bytes of n characters that no dictionary holds."""
        if n not in self.random:
            noise = b"".join(base64.b64encode(hashlib.sha256(bytes([k % 256, k // 256])).digest()) for k in range(n // 44 + 1))
            self.random[n] = max(1, self._more(b"", noise[:n]))
        return self.random[n]

    def share(self, around: str, candidate: str) -> float:
        """The part of the candidate that is new: its marginal bytes as a share of those of a random string as long, 1 at most."""
        return min(1.0, self._more(around.encode(), candidate.encode()) / self._random(len(candidate)))


def _novel(text: str, rules: SecretRules, novelty: Novelty) -> Iterator[tuple[int, int]]:
    """Novel strings after sensitive words.

    A run that holds a word itself is judged from the word on, as a whole and up to
    the next word in it; other runs, as a whole, if they start within ``reach``. A
    run is judged as a whole once and then by disjoint parts, so work is linear.
    """

    def novel(start: int, end: int) -> bool:
        value = text[start:end]
        bits = most_bits(value)
        if len(value) < 16 or bits < max(rules.min_bits, rules.min_rate * len(value)):
            return False
        if value.isalpha() and (value.islower() or value[1:].islower() or value.isupper()) and not ASSIGNED.search(text[max(0, start - 3) : start]):
            return False  # a long word of prose
        # a secret that is written twice would make each copy look known
        around = (text[max(0, start - rules.around) : start] + text[end : end + rules.around]).replace(value, "")
        return bits * novelty.share(around, value) >= max(rules.min_bits, rules.min_rate * len(value))

    words = [w.span() for w in CONTEXT.finditer(text)]
    judged = held = -1
    for k, (_, at) in enumerate(words):
        inside = at < judged or REST.match(text, at)
        if inside and at >= held:
            end = judged if at < judged else inside.end()
            after = words[k + 1][0] if k + 1 < len(words) else end
            parts = [end] if at >= judged else []
            parts += [min(after, end)] if at < judged or after < end else []
            judged = end
            if any(novel(at, x) for x in parts):
                held = end
                yield at, end
        pos = max(at, judged)
        while m := START.search(text, pos, min(len(text), at + rules.reach + 16)):
            judged = pos = REST.match(text, m.start()).end()
            if novel(m.start(), judged):
                held = judged
                yield m.start(), judged


def scan(text: str, rules: SecretRules, novelty: Novelty, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one text by start, then kind as listed; code points."""
    found = []
    if "assign" in kinds:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "access" in kinds:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if "hex" in kinds:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "novel" in kinds:
        found += [(a, b, "novel") for a, b in _novel(text, rules, novelty)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _scanned(part: pa.RecordBatch, rules: SecretRules, novelty: Novelty) -> list[list[tuple[int, int, str]]]:
    texts = pc.fill_null(part.column("text"), "")
    seen = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in ANY.items()}
    out: list[list[tuple[int, int, str]]] = []
    for row in range(part.num_rows):
        kinds = tuple(k for k in KINDS if seen[k][row])
        out.append(scan(texts[row].as_py(), rules, novelty, kinds) if kinds else [])
    return out


SPANS = "array<struct<start:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SecretRules = SecretRules()) -> DataFrame:
    """(id, text, spans) of each row: array of (start, end, kind), whole texts.

    Kinds ``assign``, ``access`` and ``hex`` are matches of patterns. ``novel``
    are strings of 16 or more characters, at most ``reach`` after a sensitive word, that tell ``min_bits`` in
    all and ``min_rate`` a character: what the kinds of their characters can tell (in parts that look like words no more than
    prose does), times the share that is new to a zstandard compressor primed with
    identifiers and the text around, against a random string as long. Letters of one case alone count only right after
    a sign of assignment. One narrow
    pass; null and empty texts have no spans; repeated rows and null ids are
    each judged alone; an empty table gives an empty result; other columns are
    ignored.
    """
    inner = keep_columns(docs, {"id": id_col, "text": text_col})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(rules)
        for part in slices(batches, "text", rules.batch_bytes):
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in _scanned(part, rules, novelty)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), pa.array(rows, kind)], names=["id", "text", "spans"])

    out = inner.mapInArrow(run, f"id {inner.schema['id'].dataType.simpleString()}, text string, spans {SPANS}")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "<SECRET>") -> str:
    """The text with each union of overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: SecretRules = SecretRules()) -> DataFrame:
    """All rows and columns, secrets in the text replaced, its length kept up to date.

    A null text stays null with a null length, an empty one stays empty; repeated rows and null ids are each
    judged alone; overlapping spans become one mark; an empty table gives an empty
    result; other columns keep their values, whatever their names.
    """
    inner = bound_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(rules)
        for part in slices(with_text(batches, place), "text", rules.batch_bytes):
            texts, spans, row = part.column("text").to_pylist(), _scanned(part, rules, novelty), part.column("row")
            clean = [t if not s else redact(t, s) for t, s in zip(texts, spans, strict=True)]
            fields = [pa.array(clean, f.type) if k == place else row.field(k) for k, f in enumerate(row.type)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], names=["row"])

    done = inner.mapInArrow(run, inner.schema)
    held = {c: F.col("row").getField(c) for c in docs.columns}
    if chars_col in held:
        held[chars_col] = F.length(held[text_col]).cast("long")
    return done.select(*[x.alias(c) for c, x in held.items()])


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of base spans and all spans as a string.

    A row for each row of ``find_secrets``, null ids and repeated rows included; without spans
    the strings are those of no spans.
    """

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def of_kind(kind: str):  # a second parameter of the lambda would be the element's place
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE).encode()).hexdigest()
