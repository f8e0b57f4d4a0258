"""Range rules: parse, test rows, route them to cleaned, unsure or fully discarded."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sievefold.functions.numbers import is_number, null_nan, to_number
from sievefold.functions.scaling import percentiles

DISCARD_ABOVE = 0.7


@dataclass(frozen=True)
class Rule:
    column: str
    lower: float | int | None
    upper: float | int | None
    confidence: float

    @property
    def numeric(self) -> bool:
        return self.lower is not None or self.upper is not None


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def parse_rules(document: str | dict, columns: Sequence[str] | None = None) -> list[Rule]:
    """Column -> [lower, upper, confidence]; malformed and unknown entries are left out."""
    items = json.loads(document) if isinstance(document, str) else document
    out = []
    for column, value in items.items():
        if isinstance(value, list) and len(value) >= 3 and _number(value[2]) and (columns is None or column in columns):
            out.append(Rule(column, *(v if _number(v) else None for v in value[:2]), float(value[2])))
    return out


def json_in(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def _bad(rules: Sequence[Rule], numeric: Collection[str]) -> list[tuple[Rule, Column]]:
    """Whether a numeric rule's column holds other text; columns of a numeric type can't."""
    return [(r, ~is_number(F.col(f"`{r.column}`"))) for r in rules if r.numeric and r.column not in numeric]


def non_numeric(rules: Sequence[Rule], numeric: Collection[str] = ()) -> Column:
    """Array of ``column='value'`` of the numeric rules' columns that hold other text.

    ``numeric`` names columns of a numeric type, whose values need no reading.
    """
    bad = [F.when(test, F.concat(F.lit(f"{r.column}='"), F.col(f"`{r.column}`").cast("string"), F.lit("'"))) for r, test in _bad(rules, numeric)]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def _tests(rules: Sequence[Rule], numeric: Collection[str] = ()) -> list[tuple[Column, str, float]]:
    tests = []
    for r in rules:
        x = F.col(f"`{r.column}`")
        x = null_nan(x.cast("double")) if r.column in numeric else to_number(x)
        if r.lower is not None:
            tests.append((x < r.lower, f"{r.column} < {r.lower}", r.confidence))
        if r.upper is not None:
            tests.append((x > r.upper, f"{r.column} > {r.upper}", r.confidence))
    return tests


def violations(rules: Sequence[Rule], numeric: Collection[str] = ()) -> Column:
    """Messages of violated bounds."""
    hits = [F.when(test, F.lit(message)) for test, message, _ in _tests(rules, numeric)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def violated_confidence(rules: Sequence[Rule], numeric: Collection[str] = ()) -> Column:
    """The largest confidence of violated rules, 0 if none is."""
    return F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(test, F.lit(c)) for test, _, c in _tests(rules, numeric)])


def route(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``violations``, ``max_confidence`` and ``decision``.

    Narrow, and so the same on a stream. The decision rests on the tests themselves, so a
    report of decisions builds no messages.
    """
    known = [r for r in rules if r.column in df.columns]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    said = any_of([F.coalesce(test, F.lit(False)) for _, test in _bad(known, numeric)])
    hit = any_of([F.coalesce(test, F.lit(False)) for test, _, _ in _tests(known, numeric)])
    highest = violated_confidence(known, numeric)
    decision = F.when(said | (highest > DISCARD_ABOVE), "fully_discarded").when(hit, "unsure").otherwise("cleaned")
    return df.withColumns({"violations": F.concat(non_numeric(known, numeric), violations(known, numeric)), "max_confidence": highest, "decision": decision})


def summary(routed: DataFrame) -> DataFrame:
    """A1."""
    return routed.groupBy("decision").agg(F.count("*").alias("n"))


def log_head(routed: DataFrame, row_id: str, n: int = 100) -> DataFrame:
    """The first rows of each decision; a report, limited by design.

    The n smallest ids come from a partial aggregate, so no class is sorted in one task.
    """
    rank = F.row_number().over(Window.partitionBy("decision").orderBy(row_id))
    return routed.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


class RuleProvider(Protocol):
    """Something that proposes rules for a frame."""

    def rules(self, df: DataFrame) -> list[Rule]: ...


@dataclass(frozen=True)
class FileRules:
    document: str

    def rules(self, df: DataFrame) -> list[Rule]:
        return parse_rules(self.document, df.columns)


@dataclass(frozen=True)
class QuantileRules:
    """Bounds at two quantiles with a low confidence; an addition of this library."""

    low: float = 0.001
    high: float = 0.999
    confidence: float = 0.3

    def rules(self, df: DataFrame) -> list[Rule]:
        names = [f.name for f in df.schema.fields if f.dataType.typeName() in {"integer", "long", "double", "float", "short"}]
        bounds = percentiles(df, [F.col(f"`{c}`") for c in names], (self.low, self.high))
        return [Rule(c, low, high, self.confidence) for c, (low, high) in zip(names, bounds, strict=True) if low is not None]


@dataclass(frozen=True)
class ModelRules:
    """Asks a model server for rules, by POST to ``url``/generate; the reply's first object is read.

    Only names, types, descriptions and a few rows leave the cluster, and only if a caller makes this provider.
    """

    url: str
    model: str
    temperature: float = 0.1
    tokens: int = 2048
    timeout: float = 300.0
    descriptions: DataFrame | None = None

    def ask(self, text: str) -> str:
        body = {"model": self.model, "message": text, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.tokens}}
        call = urllib.request.Request(f"{self.url.rstrip('/')}/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(call, timeout=self.timeout) as reply:
            answer = json.loads(reply.read())
        if "response" not in answer:
            raise ValueError(f"the model server's reply has no response: {answer}")
        return answer["response"]

    def rules(self, df: DataFrame) -> list[Rule]:
        answer = self.ask(prompt(df, self.descriptions))
        start, end = answer.find("{"), answer.rfind("}") + 1
        if start < 0 or not end:
            raise ValueError("the model's answer holds no object")
        return parse_rules(answer[start:end], df.columns)


def prompt(df: DataFrame, descriptions: DataFrame | None = None, n: int = 3) -> str:
    """Text that asks for rules, from names, types, descriptions and a few rows."""
    lines = ["Columns:"] + [f"- {f.name}: {f.dataType.simpleString()}" for f in df.schema.fields]
    if descriptions is not None:
        first, *rest = descriptions.columns
        lines += ["Descriptions:"] + ["- " + " | ".join(str(v) for v in r) for r in descriptions.limit(len(df.columns)).collect()]
    lines += ["Rows:"] + [", ".join(str(v) for v in r) for r in df.limit(n).collect()]
    lines.append('Answer with one JSON object: {"column": [lower or null, upper or null, confidence]}')
    return "\n".join(lines)


def split_writes(routed: DataFrame, path: str) -> None:
    """K1: one folder for each decision."""
    routed.withColumn("violations", F.concat_ws("; ", "violations")).write.partitionBy("decision").option("header", True).csv(path)


def any_of(tests: Sequence[Column]) -> Column:
    """False for no tests."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))
