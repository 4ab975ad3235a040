"""Token counts by a sentencepiece BPE model, without the library's own encoder.

Pre-tokens (runs of the space mark with what follows) are held as ragged numpy
arrays: one flat array of symbols, one of sequence numbers. In each round every
sequence finds the lowest rank among its adjacent pairs and merges it, all
sequences at once: all places with that rank from the left, up to the first
place where the new symbol forms a pair that must go before the rest. That
gives the order in which a queue of (rank, place) would merge.
Symbols that no piece covers count as their UTF-8 bytes.

A null text counts as empty and has 0 bytes and 0 tokens. Other columns,
whatever their names, are left out; repeated rows give repeated results. Texts of any length
are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import Kept, id_and_text, pieces
from siftstone.llm.pairs import PairTable

#: The mark that stands for a space in the model's pieces. Fixed value.
MARK = "▁"
#: Counted pre-tokens kept by a worker, none of more characters than LONGEST; beyond it the memory starts anew.
KEPT, LONGEST = 1_000_000, 64
_NONE = np.int64(1) << np.int64(40)


class RankSynchronousCounter:
    @classmethod
    def shared(cls, path: str) -> RankSynchronousCounter:
        return _COUNTERS.get(path)

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        scores = {p: model.get_score(i) for p, i in normal.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(size, _NONE)
        for p, i in normal.items():
            self.rank[i] = order[scores[p]]
        left, right, merged = [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = normal.get(p[:cut]), normal.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        self.pairs = PairTable(left, right, merged, -1)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        # Where a piece joins other characters to a mark behind them, pre-tokens would not be independent.
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece reaches over a space mark")
        self.marks = re.compile(f"{MARK}+[^{MARK}]*")
        self.seen: dict[str, int] = {}

    def _pair(self, left, right):
        """Merged piece and rank of pairs; -1 and no rank for those that don't merge."""
        piece = self.pairs.get(left, right)
        piece[(left < 0) | (right < 0)] = -1
        return piece, np.where(piece >= 0, self.rank[piece], _NONE)

    def count(self, words: list[str]) -> np.ndarray:
        """The tokens of each word; a word is a pre-token with its space marks."""
        lengths = np.array([len(w) for w in words], np.int64)
        total = np.zeros(len(words), np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sym = self.char[code].astype(np.int64)
        seq = np.repeat(np.arange(len(words)), lengths)
        bare = np.flatnonzero(sym < 0)
        np.add.at(total, seq[bare], np.searchsorted([0x80, 0x800, 0x10000], code[bare], side="right"))  # bytes beyond the symbol's own 1
        if not len(sym):
            return total
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        piece, rank = np.full(len(sym), -1), np.full(len(sym), _NONE)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        piece[inside], rank[inside] = self._pair(sym[inside], sym[inside + 1])
        while True:
            best = np.minimum.reduceat(rank, first)
            live = best < _NONE
            size = np.diff(np.r_[first, len(sym)])
            if not live.all():  # finished sequences are counted and leave
                np.add.at(total, seq[first[~live]], size[~live])
                keep = np.repeat(live, size)
                sym, seq, piece, rank = sym[keep], seq[keep], piece[keep], rank[keep]
                best, size = best[live], size[live]
                first = np.cumsum(size) - size
            if not len(sym):
                break
            low = np.repeat(best, size)
            hit = rank == low
            # of places that overlap, every other one from the left
            where = np.arange(len(sym))
            begin = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(begin, where, -1))
            at = np.flatnonzero(hit & ((where - run) % 2 == 0))
            new = piece[at]
            # what the new symbol would pair with, while places to the right stand as they are
            right = np.minimum(at + 2, len(sym) - 1)
            has_right = (at + 2 < len(sym)) & (seq[right] == seq[at])
            prior = np.maximum(at - 1, 0)
            has_left = (at > 0) & (seq[prior] == seq[at])
            joined = np.r_[False, at[1:] - at[:-1] == 2] & has_left
            before = np.where(joined, np.r_[-1, new[:-1]], sym[prior])
            _, r1 = self._pair(new, np.where(has_right, sym[right], -1))
            _, r0 = self._pair(np.where(has_left, before, -1), new)
            bad = np.minimum(r0, r1) <= low[at]
            if bad.any():
                group = seq[at]
                head = np.r_[True, group[1:] != group[:-1]]
                past = np.cumsum(bad) - bad
                past -= np.repeat(past[head], np.diff(np.r_[np.flatnonzero(head), len(at)]))
                at, new = at[past == 0], new[past == 0]
            sym[at] = new
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            # the last symbol of a merged pair goes; what it would have started goes with it
            sym, seq, piece, rank, touched = sym[keep], seq[keep], piece[keep], rank[keep], touched[keep]
            more = np.flatnonzero(touched | np.r_[touched[1:], False])
            size = np.bincount(np.searchsorted(seq[np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])], seq))
            first = np.cumsum(size) - size
            end = np.r_[seq[1:] != seq[:-1], True][more]
            piece[more[end]], rank[more[end]] = -1, _NONE
            more = more[~end]
            piece[more], rank[more] = self._pair(sym[more], sym[more + 1])
        return total

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text, each without its single leading mark (or with all marks, if it has more)."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or marked[-1] == MARK:
            return [w[1:] if w[1:2] != MARK and len(w) > 1 else w for w in self.marks.findall(marked)]
        return marked.split(MARK)[1:]

    def count_batch(self, texts: list[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.seen) if split else set()
        if new:
            if len(self.seen) + len(new) > KEPT:
                new = set().union(*split)
                self.seen.clear()
            new = list(new)
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                self.seen.update(zip(part, self.count([w if w[:1] == MARK else MARK + w for w in part]).tolist(), strict=True))
        out = [sum(map(self.seen.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > LONGEST:
                del self.seen[word]
        return out


_COUNTERS = Kept(RankSynchronousCounter)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document; no shuffle."""

    def run(batches):
        counter = RankSynchronousCounter.shared(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = np.array([x for a, b in pieces(texts, 2_000_000) for x in counter.count_batch(texts[a:b])], np.int64)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
