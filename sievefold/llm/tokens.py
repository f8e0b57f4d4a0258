"""Token counts of a BPE piece model by merging ragged numpy arrays."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from sievefold.llm.shared import keep_columns, slices

SPACE = "▁"
_NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class TokenRules:
    """The model's file, the limit, and bounds of a worker's memory."""

    model: str = "piece_bpe_32k.model"
    limit: int = 4096
    batch_bytes: int = 4 << 20
    cache_words: int = 400_000


class PieceCounter:
    """Counts the tokens of pre-tokens; see ``count``.

    Pre-tokens are runs of the space mark with what follows, up to the next
    mark; no piece has a mark after another character, which is checked, so
    no merge crosses from one pre-token to the next.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models that keep the text as it is and fall back to bytes can be counted")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        own = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in own) or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("pieces cross words")
        order = {s: k for k, s in enumerate(sorted(set(own.values()), reverse=True))}
        rank = {p: order[s] for p, s in own.items()}
        symbols = sorted({*own, *(c for p in own for c in p)})
        number = {s: k for k, s in enumerate(symbols)}
        self.size = len(symbols)
        self.weight = np.array([1 if s in own else len(s.encode()) for s in symbols], np.int64)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s in symbols:
            if len(s) == 1:
                self.of_char[ord(s)] = number[s]
        merges, self.safe = [], np.ones(len(order), bool)
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in number and b in number:
                    merges.append((number[a] * self.size + number[b], r, number[p]))
                    for part in (a, b):  # a merge that at once allows a better or equal one
                        if rank.get(part, -1) >= r:
                            self.safe[rank[part]] = False
        merges.sort()
        keys, ranks, results = np.array(merges, np.int64).T
        self.keys, self.ranks, self.results = keys.copy(), ranks.astype(np.int32), results.astype(np.int32)
        self.reach = max(map(len, own))
        pairs = {(ord(x) << 21) + ord(y) for p in own for x, y in zip(p, p[1:], strict=False)}
        self.bigrams = np.array(sorted(pairs), np.int64)
        self.cache: dict[str, int] = {}
        # blanks merge last and from the left: a long run must lose full pieces of a fixed length there
        self.period = 0
        longest = max((len(p) for p in own if set(p) == {SPACE}), default=0)
        if longest > 1:
            n = self.count([SPACE * k for k in range(1, 4 * longest)])
            if (n[3 * longest - 1 :] == n[2 * longest - 1 : 3 * longest - 1] + 1).all():
                self.period = longest

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token.

        All are held as one ragged array of symbols. In each round every
        sequence finds its lowest-rank pair and merges it: everywhere, where
        that can't bring up a pair of lower or equal rank, else at its first
        place and those too far from another to feel it. Sequences without a pair leave. What is left is counted.
        """
        pretokens = list(pretokens)
        extra = np.zeros(len(pretokens), np.int64)
        if self.period:
            for k, t in enumerate(pretokens):
                if len(t) > 4 * self.period and t.startswith(SPACE * 4 * self.period):
                    cut = (len(t) - len(t.lstrip(SPACE)) - 3 * self.period) // self.period
                    extra[k] = cut
                    pretokens[k] = t[cut * self.period :]
        points = np.frombuffer("".join(pretokens).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        owner = np.repeat(np.arange(len(pretokens)), lengths)
        # a long pre-token is also cut between characters that no piece has side by side
        heads = np.ones(len(points), bool)
        if len(points):
            heads[1:] = owner[1:] != owner[:-1]
            at = np.flatnonzero(~heads & (lengths[owner] > 64))
            key = (points[at - 1].astype(np.int64) << 21) + points[at]
            place = np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)
            heads[at[self.bigrams[place] != key]] = True
        seq = np.cumsum(heads) - 1
        total = np.zeros(int(heads.sum()), np.int64)
        sym = self.of_char[points]
        unknown = sym < 0
        if unknown.any():
            bad = points[unknown]
            np.add.at(total, seq[unknown], 1 + (bad > 0x7F) + (bad > 0x7FF) + (bad > 0xFFFF))
        while len(sym) > 1:
            a, b = sym[:-1].astype(np.int64), sym[1:]
            at = np.flatnonzero((seq[1:] == seq[:-1]) & (a >= 0) & (b >= 0))
            key = a[at] * self.size + b[at]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            at, found = at[hit], found[hit]
            rank = np.full(len(sym), _NONE, np.int32)
            rank[at] = self.ranks[found]
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            place = np.cumsum(np.r_[True, seq[1:] != seq[:-1]]) - 1
            chosen = (rank == best[place]) & ~done[place]
            where = np.flatnonzero(chosen)
            if len(where):
                new = np.r_[True, np.diff(where) != 1]
                run_start = where[new][np.cumsum(new) - 1]
                where = where[(where - run_start) % 2 == 0]
                own = place[where]
                first = np.r_[True, own[1:] != own[:-1]]
                # a merge works on what lies within the longest piece; further off it changes nothing
                far = np.r_[True, np.diff(where) > 2 * self.reach]
                where = where[first | far | self.safe[rank[where]]]
                result = np.zeros(len(sym), np.int32)
                result[at] = self.results[found]
                sym[where] = result[where]
            gone = np.zeros(len(sym), bool)
            gone[where + 1] = True
            finished = done[place]
            known = finished & (sym >= 0)
            np.add.at(total, seq[known], self.weight[sym[known]])
            stay = ~gone & ~finished
            sym, seq = sym[stay], seq[stay]
        if len(sym) and sym[0] >= 0:
            total[seq[0]] += self.weight[sym[0]]
        return extra + np.bincount(owner[heads], total, len(pretokens)).astype(np.int64)

    def cached(self, pretokens: list[str], bound: int) -> np.ndarray:
        cache = self.cache
        if len(cache) > bound:
            cache.clear()
        missing = [t for t in pretokens if t not in cache]
        for at in range(0, len(missing), 50_000):
            some = missing[at : at + 50_000]
            cache.update(zip(some, self.count(list(some)).tolist(), strict=True))
        return np.fromiter((cache[t] for t in pretokens), np.int64, len(pretokens))

    def texts(self, texts: pa.Array, bound: int) -> np.ndarray:
        """Tokens of each text; an empty text has none."""
        n = len(texts)
        full = pc.binary_join_element_wise(self.prefix, pc.replace_substring(texts, " ", SPACE), "")
        full = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", full)
        # split at single marks; texts with doubled or missing marks go the general way
        plain = pc.invert(pc.match_substring_regex(full, f"{SPACE}{SPACE}|{SPACE}$|^[^{SPACE}]")).to_numpy(zero_copy_only=False)
        out = np.zeros(n, np.int64)
        rows = np.flatnonzero(plain)
        if len(rows):
            parts = pc.split_pattern(full.take(pa.array(rows)), SPACE)
            parents = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
            words = pc.list_flatten(parts).dictionary_encode()
            counts = self.cached([SPACE + w if w else "" for w in words.dictionary.to_pylist()], bound)
            out[rows] = np.bincount(parents, counts[words.indices.to_numpy(zero_copy_only=False)], len(rows)).astype(np.int64)
        for k in np.flatnonzero(~plain).tolist():
            found = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", full[k].as_py())
            out[k] = int(self.cached(found, bound).sum()) if found else 0
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: TokenRules = TokenRules(), path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, over its whole text.

    Counts equal the library's without begin and end tokens. One narrow pass;
    each worker keeps counts of at most ``cache_words`` words and a batch. Null
    and empty texts have no bytes and no tokens; repeated rows and null ids are
    counted alike; an empty table gives an empty result; other columns are
    ignored. ``path`` is the model's file on every executor.
    """
    inner = keep_columns(docs, {"id": id_col, "text": text_col})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", rules.batch_bytes):
            texts = pc.fill_null(part.column("text"), "")
            n = counter(path or public_tokenizers.path(rules.model)).texts(texts, rules.cache_words)
            yield pa.RecordBatch.from_arrays([part.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > rules.limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = inner.schema["id"].dataType.simpleString()
    return inner.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
