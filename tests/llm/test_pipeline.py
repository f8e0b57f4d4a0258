"""The pipeline on the small table: each stage's decision takes effect."""

from __future__ import annotations

import collections
import re
import zlib
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievefold.llm import queries, secrets

WORDS = re.compile("[^\x20\x09-\x0d]+")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = docs.persist()
        assert 0 < docs.count() <= n, name
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.select("doc_id").distinct().count() == n


def words(text):
    return WORDS.findall(text or "")


def near_groups(texts):
    """Texts by group of near duplicates, all pairs compared: five lower-case words, 0.8."""
    sets = []
    for text in texts.values():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = {}
    for doc, g in zip(texts, group, strict=True):
        out.setdefault(g, []).append(doc)
    return out


def test_each_stage_gives_the_brute_force_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [[w for w in re.split(r"[\W_]+", r["text"].lower()) if w] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}

    good = stages["quality_rules"](spark, docs, sf).persist()
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    for doc, r in rows.items():
        w = words(r["text"])
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = [False] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                hit[i : i + 8] = [True] * 8
        if len(w) < 20 or 100 * sum(hit) > 30 * len(w):
            assert doc not in kept
        elif not any(n > 1 for n in collections.Counter(tuple(w[i : i + 20]) for i in range(len(w) - 19)).values()):
            assert doc in kept  # no long repeat at all

    single = stages["near_dedup"](spark, good, sf).persist()
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert sorted(left) == sorted(min(g) for g in near_groups(kept).values()) and len(left) < len(kept)

    clean = stages["decontaminate"](spark, single, sf).persist()
    fine = {r["doc_id"]: r["text"] for r in clean.collect()}
    runs = {tuple(i[k : k + 13]) for i in bench for k in range(len(i) - 12)}
    for doc, text in left.items():
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        shared = any(tuple(w[k : k + 13]) in runs for k in range(len(w) - 12))
        few = not {tuple(w[k : k + 4]) for k in range(len(w) - 3)} & {tuple(i[k : k + 4]) for i in bench for k in range(len(i) - 3)}
        assert (doc not in fine) if shared else (doc in fine or not few)

    safe = stages["secret_scan"](spark, clean, sf).persist()
    rules = secrets.SecretRules()
    novelty = secrets.Novelty(rules)
    for r in safe.collect():
        assert r["text"] == secrets.redact(fine[r["doc_id"]], secrets.scan(fine[r["doc_id"]], rules, novelty)) and r["n_chars"] == len(r["text"])
        assert r["lang"] == rows[r["doc_id"]]["lang"] and r["source"] == rows[r["doc_id"]]["source"]

    pieces = stages["pack"](spark, safe, sf).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in safe.collect():
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == r["doc_id"])
        ids = [*tokens.encode(r["text"], add_special_tokens=False).ids, 1]
        assert sum(n for _, n, _ in own) == len(ids)
        for start, n, crc in own:
            assert zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_written_tables_can_be_dropped(spark):
    from sievefold.llm import shared

    scratch = shared.Scratch(spark)
    held, other = scratch.table(spark.range(3), "held"), scratch.table(spark.range(5), "other")
    dealt = scratch.bucketed(spark.range(4), "dealt", "id")
    assert (held.count(), other.count(), dealt.count()) == (3, 5, 4)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(scratch.path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mine = set(scratch._tables)
    assert mine <= {t.name for t in spark.catalog.listTables()}
    scratch.drop()
    assert not files.exists(where) and not mine & {t.name for t in spark.catalog.listTables()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    db = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(map(tuple, want.fetchall()), key=repr)
