"""Byte-level BPE: encode whole texts by a rank file, and decode the ids again.

Each match of the pre-token pattern is merged on its own. The pairs of a
pre-token stand in the leaves of a segment tree over its byte positions, whose
inner nodes hold the minimum of (rank, position); the root is the leftmost pair of
lowest rank. A merge changes three leaves (the pair itself, the one before, the
one it swallows) and the paths above them, so a pre-token of n bytes takes
O(n log n) steps. The trees of many pre-tokens of one size class are held as
one array and step together; few pre-tokens of a class of long ones are
stepped one by one on lists.

Results are defined for every input: a null text counts as empty; an empty text
has no ids, and the sha256 of the empty string twice. Repeated rows give
repeated results; texts of any length are encoded whole; an empty table gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import Kept, give_back, id_and_text, pieces
from siftstone.llm.pairs import PairTable

#: Unicode's White_Space characters, as the pattern's \s has them. Fixed values.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Encoded runs that a worker keeps, twice: those met lately, and those met in the time before; none of more characters than LONGEST.
KEPT, LONGEST = 60_000, 128
#: Pre-tokens of a size class of LONG bytes or more that are merged one by one, if there are no more.
FEW, LONG = 8, 1024
_NONE = np.int64(1) << np.int64(62)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBPE:
    """An encoder for one rank file and pattern; `shared()` keeps one per worker."""

    @classmethod
    def shared(cls, path: str, pattern: str) -> SegmentTreeBPE:
        return _ENCODERS.get(path, pattern)

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        # No match of the pattern goes from other characters into white space, so runs of white
        # space with the characters behind them can be encoded apart from each other.
        self.runs = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        self.pairs = PairTable(left, right, merged, int(_NONE))
        self._rank_of: dict[int, int] | None = None
        self.seen: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (1 byte at least), merged by rank."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        classes = np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 1)))).astype(int)
        for c in np.unique(classes) if len(words) else ():
            rows = np.flatnonzero(classes == c)
            if len(rows) <= FEW and 1 << int(c) >= LONG:
                for i in rows:
                    out[i] = self._merge_one(words[i], 1 << int(c))
                continue
            step = max(1, (1 << 17) >> int(c))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_class([words[i] for i in part], lengths[part], 1 << int(c)), strict=True):
                    out[i] = ids
        return out

    def _merge_one(self, word: bytes, width: int) -> np.ndarray:
        """The same steps for a single pre-token, on lists."""
        n, none = len(word), int(_NONE)
        rank = self.rank_of().get
        ids = [self.ids_of_bytes[b] for b in word]
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for at in range(n - 1):
            r = rank(ids[at] << 32 | ids[at + 1])
            if r is not None:
                tree[width + at] = r * width + at
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                low = min(value, tree[node ^ 1])
                node >>= 1
                if tree[node] == low:
                    return
                tree[node] = value = low

        while tree[1] < none:
            at = tree[1] & (width - 1)
            ids[at] = tree[1] // width
            gone = follow[at]
            after, prior = follow[gone], before[at]
            follow[at], ids[gone] = after, -1
            put(gone, none)
            r = None
            if after < n:
                before[after] = at
                r = rank(ids[at] << 32 | ids[after])
            put(at, none if r is None else r * width + at)
            if prior >= 0:
                r = rank(ids[prior] << 32 | ids[at])
                put(prior, none if r is None else r * width + prior)
        return np.array([i for i in ids if i >= 0], np.int64)

    def rank_of(self) -> dict[int, int]:
        """The pairs and their ranks as a dictionary, made when first asked for."""
        if self._rank_of is None:
            used = self.pairs.values < _NONE
            self._rank_of = dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist(), strict=True))
            self.ids_of_bytes = self.byte.tolist()
        return self._rank_of

    def _merge_class(self, words, lengths, width):
        n = len(words)
        cells = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
        ids = self.byte[cells]  # one row of `width` cells for each word, all in one array
        place = np.tile(np.arange(width), n)
        follow, before = place + 1, place - 1
        last = np.repeat(lengths, width)
        value = np.full(n * width, _NONE)
        ok = np.flatnonzero(place + 1 < last)
        value[ok] = self._leaf(ids[ok], ids[ok + 1], place[ok], width)
        tree = np.full(2 * n * width, _NONE)
        grid = tree.reshape(n, 2 * width)
        grid[:, width:] = value.reshape(n, width)
        level = width >> 1
        while level:
            below = grid[:, 2 * level : 4 * level]
            grid[:, level : 2 * level] = np.minimum(below[:, ::2], below[:, 1::2])
            level >>= 1
        alive = np.zeros(n * width, bool)
        alive[place < last] = True
        row = np.arange(n)
        while True:
            root = tree[row * (2 * width) + 1]
            go = root < _NONE
            row, root = row[go], root[go]
            if not len(row):
                break
            base = row * width
            at = root & (width - 1)
            gone = follow[base + at]
            after = follow[base + gone]
            prior = before[base + at]
            ids[base + at] = root >> (width.bit_length() - 1)
            alive[base + gone] = False
            follow[base + at] = after
            inside = after < lengths[row]
            before[(base + after)[inside]] = at[inside]
            leaf = np.full(len(row), _NONE)
            leaf[inside] = self._leaf(ids[(base + at)[inside]], ids[(base + after)[inside]], at[inside], width)
            top = row * (2 * width)
            tree[top + width + at] = leaf
            tree[top + width + gone] = _NONE
            led = prior >= 0
            tree[(top + width + prior)[led]] = self._leaf(ids[(base + prior)[led]], ids[(base + at)[led]], prior[led], width)
            for t, leaf_at in ((top, at), (top, gone), (top[led], prior[led])):
                node = (leaf_at + width) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[t + node] = np.minimum(tree[t + 2 * node], tree[t + 2 * node + 1])
                    node = node >> 1
        kept = np.add.reduceat(alive, np.arange(0, n * width, width)) if n else ()
        return np.split(ids[alive], np.cumsum(kept)[:-1])

    def _leaf(self, left, right, place, width):
        rank = self.pairs.get(left, right)
        return np.where(rank < _NONE, rank * width + place, _NONE)

    def _learn(self, runs: set[str]) -> None:
        """Encode runs not seen yet."""
        runs = list(runs)
        words: dict[bytes, int] = {}
        split = [[words.setdefault(m.encode(), len(words)) for m in self.pattern.findall(r)] for r in runs]
        whole = list(words)
        done: list = [self.ranks.get(w) for w in whole]
        todo = [i for i, x in enumerate(done) if x is None]
        done = [np.array([x], np.int64) if x is not None else None for x in done]
        for i, ids in zip(todo, self.merge([whole[i] for i in todo]), strict=True):
            done[i] = ids
        for run, parts in zip(runs, split, strict=True):
            ids = done[parts[0]] if len(parts) == 1 else np.concatenate([done[p] for p in parts])
            self.seen[run] = (",".join(map(str, ids.tolist())).encode(), ids.astype("<u4").tobytes())

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids, as decimal text joined by commas and as an array."""
        split = [self.runs.findall(t) for t in texts]
        if len(self.seen) > KEPT:
            self.before, self.seen = self.seen, {}
        new = set().union(*split).difference(self.seen)
        for run in new & self.before.keys():
            self.seen[run] = self.before[run]
        self._learn(new.difference(self.seen))
        out = []
        for runs in split:
            got = list(map(self.seen.__getitem__, runs))
            out.append((b",".join([g[0] for g in got]), np.frombuffer(b"".join([g[1] for g in got]), "<u4")))
        for run in new:
            if len(run) > LONGEST:
                del self.seen[run]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))


_ENCODERS = Kept(lambda path, pattern: SegmentTreeBPE(load_ranks(path), pattern))
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: what encoding its text and decoding the ids gives.

    No shuffle; a worker holds one batch of texts and some 2 * KEPT encoded runs of LONGEST characters at most.
    """

    def run(batches):
        for batch in batches:
            bpe = SegmentTreeBPE.shared(path, pattern)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, ids_sha, out_sha, same = [], [], [], []
            for a, b in pieces(texts, 1_000_000):
                for text, (decimal, ids) in zip(texts[a:b], bpe.encode_batch(texts[a:b]), strict=True):
                    back = bpe.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(decimal).hexdigest())
                    out_sha.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
            give_back()

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids themselves."""

    def run(batches):
        bpe = SegmentTreeBPE.shared(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [i.astype(np.int32) for a, b in pieces(texts, 1_000_000) for _, i in bpe.encode_batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")
