"""SimHash near-duplicates found by Golay-code fuzzy hashing.

`fingerprints` gives each document 64 bits: a bit is 1 where over half of its
shingles' hashes have it. `link_classes` finds all pairs of distinct
fingerprints at 2 bits or fewer, exactly:

* The 64 bits are segments A (23 bits), B (23) and C (18). Of two errors at most,
  A is free of them, or B is, or both have one and C has none. So the keys are
  (A, a Golay key of B), (B, a Golay key of A) and (C, a Golay key of A), 16 a
  fingerprint on average, and two linked fingerprints share one of them.
* A key with two fingerprints gives a pair, verified by its bits.
* The fingerprints of a key with three or more (few, but one group of near copies
  can hold very many) are not paired with each other. Each sends its 65
  words at one bit or fewer; fingerprints that meet in such a word are at two bits
  or fewer from each other, 65 of them at most, and are linked to the least.
  Any linked pair of such a key meets in a word, so no link is lost, and the
  work grows with the number of fingerprints, not with its square.

Components are then taken over the links.

`near_groups` serves corpora whose near copies differ by more than two bits: see
its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm import golay
from siftstone.llm.common import checkpointed, give_back, id_and_text
from siftstone.operators.graph import connected_components

SEED = 42
_M23, _M18 = np.uint64((1 << 23) - 1), np.uint64((1 << 18) - 1)


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence, if it has fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    form = b" ".join([b"%b"] * size)
    return np.array([h(form % s, SEED) for s in zip(*(words[i:] for i in range(size)), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if over half of the hashes have it; 0 without any."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a long text
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): a signed long of the 64 bits. A null text counts as empty, with fingerprint 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(shingle_hashes(words_of(t or b""), shingle)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
            give_back()

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _golay_rows(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        u = fp.view(np.uint64)
        a, b, c = u & _M23, (u >> np.uint64(23)) & _M23, u >> np.uint64(46)
        (at_a, key_a), (at_b, key_b) = golay.keys(a), golay.keys(b)
        at = np.r_[at_b, at_a, at_a]
        key = np.r_[a.astype(np.int64)[at_b] << 12 | key_b, (1 << 40) | b.astype(np.int64)[at_a] << 12 | key_a, (2 << 40) | c.astype(np.int64)[at_a] << 12 | key_a]
        yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(key)], ["fp", "key"])


def link_classes(distinct: DataFrame) -> DataFrame:
    """(u, v): links among distinct fingerprints (fp) whose components are those of all pairs at 2 bits or fewer."""
    keyed = distinct.select("fp").mapInArrow(_golay_rows, "fp long, key long")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1")
    pairs = met.filter("n = 2 and bit_count(u ^ v) <= 2").select("u", "v")
    crowded = met.filter("n > 2").select("key")
    hot = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    near = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    words = hot.select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    cliques = words.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    stars = cliques.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v")
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of `docs`.

    Rows with equal texts have one fingerprint and hence one component, however
    many they are; empty and null texts have fingerprint 0, linked like any
    other. component_id is the least non-null doc_id reachable (null if there is none).
    """
    fps = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(connected_components(link_classes(classes)))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = joined.filter("component is not null")
    label = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    names = linked.join(label, "component").select("fp", "component_id").union(joined.filter("component is null").select("fp", F.col("least").alias("component_id")))
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies at a similarity of shingle sets, beyond two bits.

#: 5-word shingles, a Jaccard similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8
SEGMENTS = 5
#: Share of a text's shingles, those of least hash, that a first comparison reads.
FIRST = 0.25
#: Texts, and words of them, that one task searches at once; larger groups are split.
BLOCK_TEXTS, BLOCK_WORDS = 4096, 1_000_000
#: Rows that are broadcast at most; longer lists are joined by a shuffle.
BROADCAST_ROWS = 500_000
_MIXERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIXERS[k]
    return h ^ (h >> np.uint64(32))


def sketch(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(5 x 23 SimHash bits of a text's distinct words as numbers, 5 anchors).

    An anchor is the least mixed hash of a text's 3-word shingles; near copies have the
    same one but for the share of shingles in which they differ.
    """
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in set(words)], np.uint64)
    if not len(h):
        return np.zeros(SEGMENTS, np.int64), np.zeros(SEGMENTS, np.uint64)
    both = np.stack([_mixed(h, 0), _mixed(h, 1)], axis=1).astype("<u8")
    ones = np.unpackbits(both.view(np.uint8).reshape(len(h), 16), axis=1, bitorder="little")[:, : SEGMENTS * golay.BITS].sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).reshape(SEGMENTS, golay.BITS)
    shingles = shingle_hashes(words, 3)
    return bits @ (1 << np.arange(golay.BITS)), np.array([_mixed(shingles, k).min() for k in range(SEGMENTS)])


def text_id(text: str) -> Column:
    """A 128-bit hash of each whole text, as hexadecimal digits; null counts as empty."""

    @F.arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        give_back()
        return pa.array([xxhash.xxh3_128_hexdigest(t or b"") for t in column.cast(pa.binary()).to_pylist()], pa.string())

    return digest(F.col(text).cast("string"))


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            done = [sketch(words_of(t)) for t in texts]
            seg = np.array([s for s, _ in done], np.int64).reshape(-1, SEGMENTS)
            anchor = np.array([a for _, a in done], np.uint64).reshape(-1, SEGMENTS).view(np.int64)
            words = pa.array([len(t.split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_hexdigest(t) for t in texts], pa.string()), pa.array(list(seg), pa.list_(pa.int64())), pa.array(list(anchor), pa.list_(pa.int64())), words], ["doc_id", "node", "segments", "anchors", "words"])
            give_back()

    return id_and_text(docs).mapInArrow(run, "doc_id long, node string, segments array<long>, anchors array<long>, words long")


def _keyed(batches):
    """Keys of each text: for each segment, its anchor with each Golay key."""
    for batch in batches:
        seg = batch.column("segments").values.to_numpy().reshape(-1, SEGMENTS)
        anchor = batch.column("anchors").values.to_numpy().reshape(-1, SEGMENTS).view(np.uint64)
        at, key = [], []
        for k in range(SEGMENTS):
            rows, codes = golay.keys(seg[:, k])
            at.append(rows)
            key.append(_mixed(anchor[rows, k] ^ _mixed((codes + 4096 * k).astype(np.uint64), 2), 3))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), batch.column("node").take(pa.array(np.concatenate(at)))], ["key", "node"])
        give_back()


def _similar(batches):
    for batch in batches:
        u, v = batch.column("su").to_pylist(), batch.column("sv").to_pylist()
        keep = []
        for a, b in zip(u, v, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
        give_back()


def first_hashes(hashes: np.ndarray) -> np.ndarray:
    """The first FIRST of a text's sorted shingle hashes, one at least; as many, too, as a similar text cannot lack all of."""
    return hashes[: int(np.ceil(FIRST * len(hashes))) + 1]


def at_most(x: np.ndarray, m: int, y: np.ndarray, n: int) -> int:
    """A bound on the common shingles of two texts of m and n shingles, from their first hashes x and y.

    Up to the lesser end of x and y all shingles of both are known; beyond it, no more are common than the one with fewer has left.
    """
    if not len(x) or not len(y):
        return 0
    end = min(x[-1], y[-1]) if len(x) < m and len(y) < n else x[-1] if len(x) < m else y[-1] if len(y) < n else max(x[-1], y[-1])
    i, j = np.searchsorted(x, end, "right"), np.searchsorted(y, end, "right")
    return len(np.intersect1d(x[:i], y[:j], assume_unique=True)) + int(min(m - i, n - j))


def _possible(batches):
    """Edges whose texts may be similar by their first hashes."""
    for batch in batches:
        first = [[np.frombuffer(b, np.uint64) for b in batch.column(c).to_pylist()] for c in ("fu", "fv")]
        sizes = [batch.column(c).to_pylist() for c in ("nu", "nv")]
        keep = [at_most(x, m, y, n) >= SIMILARITY / (1 + SIMILARITY) * (m + n) - 1e-6 for x, y, m, n in zip(*first, *sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
        give_back()


def _meetings(at: np.ndarray, token: np.ndarray, label: np.ndarray, n: int):
    """(x, the texts before x that share a token with it) for texts `at` of each token; tokens whose texts have one label are left out."""
    order = np.argsort(token, kind="stable")
    at, token = at[order], token[order]
    if not len(at):
        return
    begins = np.flatnonzero(np.r_[True, np.diff(token) > 0])
    ends = np.r_[begins[1:], len(at)]
    mixed = np.flatnonzero(np.minimum.reduceat(label[at], begins) != np.maximum.reduceat(label[at], begins))
    lists: dict[int, list[np.ndarray]] = {}
    for b, e in zip(begins[mixed], ends[mixed], strict=True):
        some = np.sort(at[b:e])
        for x in some[1:]:
            lists.setdefault(int(x), []).append(some)
    met = np.zeros(n, bool)
    for x in sorted(lists):
        for others in lists[x]:
            met[others] = True
        y = np.flatnonzero(met[:x])
        met[:] = False
        yield x, y


def _may_link(table: pa.Table) -> pa.Table:
    """The texts of a group (k, anchor, node, component, size, first) that may be similar to one of another component, by their first hashes.

    None is lost: a similar text has one of the first hashes in common, of as many as it cannot lack all of, a fitting size, and enough
    common shingles by the bound of `at_most`.
    """
    size = table.column("size").to_numpy().astype(np.int64)
    by_size = np.argsort(size, kind="stable")
    size = size[by_size]
    first = table.column("first").to_pylist()
    first = [np.frombuffer(first[k], np.uint64) for k in by_size]
    label = np.unique(np.array(table.column("component").to_pylist(), object), return_inverse=True)[1][by_size]
    length = np.array([len(f) for f in first], np.int64)
    start = np.cumsum(length) - length
    flat = np.concatenate(first)
    _, token = np.unique(flat, return_inverse=True)
    member = np.repeat(np.arange(len(first)), length)
    looked_up = size - np.ceil(SIMILARITY * size - 1e-6).astype(np.int64) + 1
    place = np.arange(len(flat)) - start[member]
    head = place < looked_up[member]
    last = np.array([f[-1] if len(f) < n else np.iinfo(np.uint64).max for f, n in zip(first, size, strict=True)], np.uint64)
    kept = np.zeros(len(first), bool)
    kept[size == 0] = (size == 0).sum() > 1
    has = np.zeros(token.max(initial=0) + 1, np.int32)
    for x, y in _meetings(member[head], token[head], label, len(first)):
        y = y[(label[y] != label[x]) & (size[y] >= SIMILARITY * size[x] - 1e-6)]
        if not len(y):
            continue
        mine = token[start[x] : start[x] + length[x]]
        has[mine] = 1
        to = np.cumsum(length[y]) - length[y]
        theirs = np.arange(length[y].sum()) + np.repeat(start[y] - to, length[y])
        known = flat[theirs] <= last[x]
        common = np.add.reduceat(has[token[theirs]] * known, to)
        has[mine] = 0
        i, j = np.searchsorted(first[x], last[y], "right"), np.add.reduceat(known, to)
        fits = common + np.minimum(size[x] - i, size[y] - j) >= SIMILARITY / (1 + SIMILARITY) * (size[x] + size[y]) - 1e-6
        kept[y[fits]] = True
        kept[x] |= fits.any()
    give_back()
    stay = np.sort(by_size[kept])
    return table.select(["k", "anchor", "node", "component"]).take(pa.array(stay))


def _crossing_links(table: pa.Table) -> pa.Table:
    """Links (u, v) between components, such that all pairs of the table's texts at SIMILARITY are within one then.

    Exact: of each text, the shingles that are rarest in the table are looked up, as many as a similar
    text cannot lack all of; each text that has one of them, a fitting size and another component is compared
    by its whole set. Where some texts are visitors (not `home`), only pairs of a visitor and a text at home are compared.
    """
    component, shingles = table.column("component").to_pylist(), table.column("shingles").to_pylist()
    by_size = sorted(range(len(shingles)), key=lambda k: len(shingles[k]))
    names, label = np.unique(np.array([component[k] for k in by_size], object), return_inverse=True)
    home = table.column("home").to_numpy(zero_copy_only=False)[by_size]
    visited = not home.all()
    size = np.array([len(shingles[k]) // 8 for k in by_size])
    first = label.copy()
    links: list[tuple[int, int]] = []

    def link(x: int, others: np.ndarray) -> None:
        for y in others:
            if label[y] != label[x]:
                links.append((int(first[x]), int(first[y])))
                label[label == label[y]] = label[x]

    link(0, np.flatnonzero(size == 0) if size[0] == 0 else np.zeros(0, np.int64))
    _, token, texts = np.unique(np.frombuffer(b"".join(shingles[k] for k in by_size), np.uint64), return_inverse=True, return_counts=True)
    start = np.cumsum(size) - size
    member = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((token, texts[token], member))
    looked_up = size - np.ceil(SIMILARITY * size - 1e-6).astype(np.int64) + 1
    order = order[(np.arange(len(order)) - start[member] < looked_up[member]) & (texts[token[order]] > 1)]
    has = np.zeros(len(texts), np.int32)
    for x, y in _meetings(member[order], token[order], label.copy(), len(size)):
        y = y[(label[y] != label[x]) & (size[y] >= SIMILARITY * size[x] - 1e-6)]
        if visited:
            y = y[home[y] != home[x]]
        if not len(y):
            continue
        mine = token[start[x] : start[x] + size[x]]
        has[mine] = 1
        to = np.cumsum(size[y]) - size[y]
        common = np.add.reduceat(has[token[np.arange(size[y].sum()) + np.repeat(start[y] - to, size[y])]], to)
        has[mine] = 0
        link(x, y[common >= SIMILARITY * (size[x] + size[y] - common) - 1e-9])
    give_back()
    return pa.table({"u": pa.array([names[a] for a, _ in links], pa.string()), "v": pa.array([names[b] for _, b in links], pa.string())})


def _limited(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it is a checked, small number of rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _of_texts(docs: DataFrame, texts: DataFrame, columns: dict[str, tuple[str, pa.DataType, Callable]]) -> DataFrame:
    """(node, columns) of `texts` (node, least), read from `docs` again: each column is a function of a text's sorted, distinct shingle hashes.

    One pass of Python gives the name of a text with what is made of it; texts that share an id, but are not asked for, go afterwards.
    """
    least = F.lit(-(2**63))
    needed = checkpointed(texts.select("node", F.coalesce("least", least).alias("id")))

    def run(batches):
        for batch in batches:
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sets = [np.unique(shingle_hashes(words_of(t), SHINGLE)) for t in raw]
            made = [pa.array([f(s) for s in sets], kind) for _, kind, f in columns.values()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([xxhash.xxh3_128_hexdigest(t) for t in raw], pa.string()), *made], ["id", "node", *columns])
            give_back()

    schema = ", ".join(["id long", "node string", *(f"{name} {kind}" for name, (kind, _, _) in columns.items())])
    chosen = id_and_text(docs).select(F.coalesce("doc_id", least).alias("id"), "text").join(_limited(needed.select("id").distinct()), "id", "left_semi")
    return checkpointed(chosen.mapInArrow(run, schema).join(_limited(needed), ["id", "node"], "left_semi").drop("id").dropDuplicates(["node"]))


def _shingle_sets(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, shingles) of `texts`: the sorted, distinct hashes of the shingles."""
    return _of_texts(docs, texts, {"shingles": ("binary", pa.binary(), lambda s: s.tobytes())})


def _first_sets(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, size, first) of `texts`: how many distinct shingles they have, and the first hashes of them."""
    return _of_texts(docs, texts, {"size": ("long", pa.int64(), len), "first": ("binary", pa.binary(), lambda s: first_hashes(s).tobytes())})


def _group_sizes(members: DataFrame, by: list[str]) -> DataFrame:
    """Groups of `members` that hold several components: n, words, and the largest component's name, n and words.

    Groups of the same texts, as near copies share several anchors, are named once. Rows meet as counts
    of each component, so a group of any size needs no task of its own.
    """
    each = members.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("c"), F.sum("words").alias("w"), F.expr("bit_xor(xxhash64(node))").alias("s"), F.expr("bit_xor(xxhash64(node, 1))").alias("s2"))
    most = F.max(F.struct("c", "component", "w"))
    groups = each.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("w").alias("words"), most.alias("most"), F.expr("bit_xor(s)").alias("s"), F.expr("bit_xor(s2)").alias("s2"))
    named = F.struct(*by, "words", "most")
    return groups.filter("n > most.c").groupBy("n", "s", "s2").agg(F.min(named).alias("g")).select("g.*", "n")


def _prefix_tokens(members: DataFrame, sets: DataFrame) -> DataFrame:
    """`members` of large groups once for each shingle (token) that is among their rarest of the group.

    As many as a similar text cannot lack all of: two texts at SIMILARITY have one in common.
    """

    def tokens(batches):
        for batch in batches:
            found = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            size = pa.array(np.array([len(f) for f in found], np.int64))
            columns = [batch.column(c).take(at) for c in ("k", "anchor", "node", "component", "words")]
            yield pa.RecordBatch.from_arrays([*columns, size.take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["k", "anchor", "node", "component", "words", "size", "token"])

    each = members.join(sets, "node").select("k", "anchor", "node", "component", "words", "shingles").mapInArrow(tokens, "k int, anchor long, node string, component string, words long, size long, token long")
    common = each.groupBy("k", "anchor", "token").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("k", "anchor", "node").orderBy("df", "token")
    looked_up = F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-6) + 1
    ranked = each.join(common, ["k", "anchor", "token"]).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= looked_up) & (F.col("df") > 1)).select("k", "anchor", "token", "node", "component", "words")


def _dealt(members: DataFrame, groups: DataFrame) -> DataFrame:
    """`members` of `groups` dealt to blocks (i, j) of bounded size.

    A group within the bounds is one block. In a larger one, a text is at home in its block i; the texts
    outside the largest component are also dealt to blocks j and visit each block i. So a crowd that is one component already,
    but for a few texts, is read once, and each of the few is held against all of it.
    """
    by = ["k", "anchor", "token"]
    blocks = lambda n, words: F.greatest(F.lit(1), F.ceil(n / BLOCK_TEXTS), F.ceil(words / BLOCK_WORDS)).cast("int")
    at_home = blocks(F.col("n"), F.col("words")).alias("at_home")
    visiting = F.when(at_home > 1, blocks(F.col("n") - F.col("most.c"), F.col("words") - F.col("most.w"))).otherwise(1).alias("visiting")
    joined = members.drop("words").join(_limited(checkpointed(groups.select(*by, at_home, visiting, F.col("most.component").alias("largest")))), by)
    own = F.pmod(F.xxhash64("node"), F.col("at_home")).cast("int")
    home = joined.select(*by, own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("visiting") - 1)).alias("j"), F.lit(True).alias("home"), "node", "component")
    guests = joined.filter("at_home > 1 and component <> largest")
    seat = F.pmod(F.xxhash64("node", F.lit(1)), F.col("visiting")).cast("int")
    visits = guests.select(*by, F.explode(F.sequence(F.lit(0), F.col("at_home") - 1)).alias("i"), seat.alias("j"), F.lit(False).alias("home"), "node", "component")
    return home.union(visits)


def _links_of_anchors(docs: DataFrame, texts: DataFrame, firsts: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(u, v): links between components of `texts` among those that share an anchor; None if no anchor has two components.

    Of a group, only the texts that may link by their first hashes are compared by whole sets.
    A group beyond one task's bounds is split by its texts' rarest shingles, each with its own, smaller list of texts,
    as texts of one passage and else different share none of them. Lists of one component are dropped, as are groups.
    `firsts` and `sets` are of texts that have been read before.
    """
    members = checkpointed(texts.select(F.posexplode("anchors").alias("k", "anchor"), "node", "component", "words"))
    groups = checkpointed(_group_sizes(members, ["k", "anchor"]).filter("n > 2"))
    if groups.isEmpty():
        return None
    bounded = (F.col("n") <= BLOCK_TEXTS) & (F.col("words") <= BLOCK_WORDS)
    of = lambda some: members.join(_limited(some.select("k", "anchor")), ["k", "anchor"], "left_semi")
    unread = lambda some, known: texts.join(some.select("node").distinct(), "node", "left_semi").join(known, "node", "left_anti")
    small = checkpointed(of(groups.filter(bounded)).drop("words"))
    all_firsts = firsts.unionByName(_first_sets(docs, unread(small, firsts)))
    may = small.join(all_firsts, "node").groupBy("k", "anchor").applyInArrow(_may_link, "k int, anchor long, node string, component string")
    by = ["k", "anchor", "token"]
    block = [*by, "i", "j", "home"]
    dealt = checkpointed(may.select("k", "anchor", F.lit(0).cast("long").alias("token"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("home"), "node", "component"))
    all_sets = sets.unionByName(_shingle_sets(docs, unread(dealt, sets)))
    large = groups.filter(~bounded)
    if not large.isEmpty():
        crowd = checkpointed(of(large))
        all_sets = all_sets.unionByName(_shingle_sets(docs, unread(crowd, all_sets)))
        lists = checkpointed(_prefix_tokens(crowd, all_sets))
        dealt = dealt.unionByName(_dealt(lists, _group_sizes(lists, by)).select(*block, "node", "component"))
    found = dealt.join(all_sets, "node").select(*block, "component", "shingles")
    return found.groupBy(*by, "i", "j").applyInArrow(_crossing_links, "u string, v string")


def near_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, components): rows (doc_id, node) of all documents, and (node, least, component).

    Near copies at 5-word shingles and a similarity of 0.8 differ in some 4 of 64 bits on
    words, in 9 on shingles: too many for the exact search at two bits. So candidates
    come from five segments of a SimHash of the distinct words. Each is taken with an anchor,
    the 3-word shingle of least hash, as its key is short; a text has all Golay keys of a segment,
    27 in all. Texts that share a key are candidates; at a similarity of 0.8 a pair shares one
    with a probability over 0.99. Links are verified by the exact similarity of the whole texts' shingle sets, after
    a first comparison of the quarter of least hashes (`at_most`) that no similar pair fails.

    The texts of a key are first held against the least of them: one edge a text and key, whatever the group's size, and the
    same least text under most keys of a crowd. That joins the most of a crowd. What may still be apart shares its anchor,
    so all texts of an anchor that has several components, whatever their Golay keys, are then searched
    exactly for links between components (`_links_of_anchors`). No candidate pair at 0.8 is lost, and
    there is no bound on partners.
    """
    rows = checkpointed(_sketches(docs))
    texts = checkpointed(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("segments").alias("segments"), F.min("anchors").alias("anchors"), F.min("words").alias("words")))
    keyed = texts.select("node", "segments", "anchors").mapInArrow(_keyed, "key long, node string")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("u")).filter("n > 1").select("key", "u")
    edges = checkpointed(keyed.join(met, "key").filter("u <> node").select("u", F.col("node").alias("v")).distinct())

    ends = lambda edges: texts.join(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct(), "node", "left_semi")
    firsts = _first_sets(docs, ends(edges))
    side = lambda end: firsts.select(F.col("node").alias(end), F.col("size").alias(f"n{end}"), F.col("first").alias(f"f{end}"))
    near = checkpointed(edges.join(side("v"), "v").join(side("u"), "u").select("u", "v", "nu", "nv", "fu", "fv").mapInArrow(_possible, "u string, v string"))
    sets = _shingle_sets(docs, ends(near))
    whole = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}"))
    links = near.join(whole("v"), "v").join(whole("u"), "u").select("u", "v", "su", "sv").mapInArrow(_similar, "u string, v string")
    roots = checkpointed(connected_components(links))
    linked = checkpointed(texts.drop("segments").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node")))
    more = _links_of_anchors(docs, linked, firsts, sets)
    components = linked.select("node", "least", "component")
    if more is not None:
        joined = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("_joined"))
        components = components.join(joined, "component", "left").select("node", "least", F.coalesce("_joined", "component").alias("component"))
    return rows.select("doc_id", "node"), components


def near_dedup(docs: DataFrame) -> DataFrame:
    """`docs`, with its own columns, one document left of each group of exact and near copies.

    The one with the least doc_id stays (null ids count as least); of rows with that id and text, the one whose
    columns as JSON have the least SHA-256. Null texts count as empty, and all empty texts are one group. Texts of any length are read whole.
    Columns besides doc_id and text may have any name.
    """
    rows, components = near_components(docs)
    least = F.lit(-(2**63))
    rows_of = rows.select(F.coalesce("doc_id", least).alias("id"), "node").groupBy("id", "node").count()
    grouped = checkpointed(rows_of.join(components.select("node", "component"), "node"))
    # groups of several rows only; all other rows are single
    first = grouped.groupBy("component").agg(F.min(F.struct("id", "node")).alias("first"), F.sum("count").alias("n")).filter("n > 1").select("component", "first")
    marked = grouped.join(_limited(checkpointed(first)), "component")
    goes = (F.col("first.id") != F.col("id")) | (F.col("first.node") != F.col("node"))
    marks = checkpointed(marked.withColumn("goes", goes).filter("goes or count > 1").select("id", "node", "goes"))
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(docs["doc_id"].cast("long"), least).alias("id"), text_id("text").alias("node"))
    joined = packed.join(_limited(marks), ["id", "node"], "left")
    single = joined.filter("goes is null").select("row")
    if not marks.filter("not goes").isEmpty():
        chosen = joined.filter("not goes").groupBy("id", "node").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
        single = single.union(chosen.select("row"))
    return single.select("row.*")
