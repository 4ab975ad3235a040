"""Token ids in a compressed binary form: canonical length-limited Huffman coding.

`encode_ids` gives each document's ids; `write_ids` stores a token table in
ascending doc_id order and `read_ids` decodes it again. The stored form is a
Parquet table of blocks, so that any file system that Spark reaches will do:

  codebook   one row: the code length of each id (bytes, zlib)
  blocks     part, block, doc_ids, sizes, n, payload: the ids of consecutive
             documents, some 262,144 of them, one document at least

A payload is magic "SSH1", the number of ids, the number of checkpoints, the bit
offset of every 128th id (unsigned 64-bit), and the bit stream. Blocks are
independent of each other. Decoding starts at all checkpoints at once and looks
each next code up in a table of 2^17 entries.

Code lengths come from the counts of all ids of the corpus, limited to 17 bits by
the package-merge method; canonical codes need no more than the lengths.

A null text counts as empty; each document ends with id 1, so that an empty one
has one id. Null doc_ids come first; repeated doc_ids keep together, in the order of a hash of their ids. Texts of any length are encoded
whole. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import Kept, id_and_text, pieces, stored

END = 1
LIMIT = 17
EVERY = 128
BLOCK = 262_144
#: Encoded chunks, and words, that a worker keeps, twice: those met lately, and those met in the time before; none of more bytes than LONGEST.
KEPT, LONGEST = 250_000, 128
#: The splitting that `ChunkEncoder` does itself; a tokenizer with any other goes through the library as it is. Fixed values.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ChunkEncoder:
    """The tokenizers library, with the ids of chunks that are free of white space kept.

    The tokenizer splits at white space and drops it, so a text's ids are those of
    its chunks. A text or new chunk of letters of western Europe, digits and ASCII marks is
    split here into the words that the tokenizer's pattern gives, and each word not
    met before goes to the library's BPE model. Any other chunk (apostrophes, other
    scripts, combining marks, added tokens) goes through the library as a whole; such
    chunks go together, parted by an added token, at which it splits before anything else.
    """

    #: Letters whose lower case is one letter and whose composed form is their own. Fixed values.
    LETTERS = "a-z\xdf-\xf6\xf8-\xff"
    UPPER = "A-Z\xc0-\xd6\xd8-\xde"

    @classmethod
    def shared(cls, path: str) -> ChunkEncoder:
        return _ENCODERS.get(path)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits; this vocabulary has more")
        settings = json.loads(self.tokenizer.to_str())
        steps = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.known = bool(added) and settings["normalizer"] == KNOWN_NORMALIZER and settings["post_processor"] is None and settings["truncation"] is None and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": KNOWN_PATTERN} and not steps[1]["add_prefix_space"]
        if not self.known:
            return
        self.part = added[-1][1].content
        self.part_id = added[-1][0]
        self.special = [a.content.encode() for _, a in added]
        self.plain = re.compile(f"[!-&(-~{self.LETTERS}{self.UPPER}]+").fullmatch
        self.split = re.compile(f"[{self.LETTERS}]+|[0-9]|[^{self.LETTERS}0-9]+").findall
        self.plain_text = re.compile(f"[\t-\r !-&(-~{self.LETTERS}{self.UPPER}]*").fullmatch
        self.split_text = re.compile(f"[{self.LETTERS}]+|[0-9]|[^{self.LETTERS}0-9\t-\r ]+").findall
        self.bytes = byte_characters()
        self.model = self.tokenizer.model
        self.seen: dict[bytes, bytes] = {}
        self.seen_before: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words_before.get(word)
        if ids is None:
            shown = word if word.isascii() else "".join(map(self.bytes.__getitem__, word.encode()))
            ids = array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(word) <= LONGEST:
            self.words[word] = ids
        return ids

    def _learn(self, chunks: set[bytes]) -> None:
        if len(self.words) > KEPT:
            self.words_before, self.words = self.words, {}
        whole, other, words = [], [], self.words
        for c in chunks:
            text = c.decode()
            if self.plain(text) and not (b"<|" in c and any(s in c for s in self.special)):
                self.seen[c] = b"".join([words.get(w) or self._word(w) for w in self.split(text.lower())])
            elif any(s in c for s in self.special):
                other.append(c)
            else:
                whole.append(c)
        for k in range(0, len(whole), 20_000):
            some = whole[k : k + 20_000]
            ids = np.array(self.tokenizer.encode(self.part.join([c.decode() for c in some]), add_special_tokens=False).ids, "<u2")
            parts = np.split(ids, np.flatnonzero(ids == self.part_id))
            self.seen.update(zip(some, [parts[0].tobytes(), *(a[1:].tobytes() for a in parts[1:])], strict=True))
        for c in other:
            self.seen[c] = np.array(self.tokenizer.encode(c.decode(), add_special_tokens=False).ids, "<u2").tobytes()

    def _plain(self, text: bytes) -> bytes | None:
        """The ids of a text of known letters and marks; None for any other."""
        decoded = text.decode()
        if b"<|" in text or not self.plain_text(decoded):
            return None
        if len(self.words) > KEPT:
            self.words_before, self.words = self.words, {}
        words = self.words
        return b"".join([words.get(w) or self._word(w) for w in self.split_text(decoded.lower())])

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        if not self.known:
            return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        out = [self._plain(t) for t in texts]
        other = [k for k, ids in enumerate(out) if ids is None]
        split = [texts[k].split() for k in other]
        if len(self.seen) > KEPT:
            self.seen_before, self.seen = self.seen, {}
        new = set().union(*split).difference(self.seen)
        for c in new & self.seen_before.keys():
            self.seen[c] = self.seen_before[c]
        self._learn(new.difference(self.seen))
        for k, chunks in zip(other, split, strict=True):
            out[k] = b"".join(map(self.seen.__getitem__, chunks))
        for c in new:
            if len(c) > LONGEST:
                del self.seen[c]
        return out


_ENCODERS = Kept(ChunkEncoder)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of the whole text with the end id, 16 bits each."""

    def run(batches):
        encoder = ChunkEncoder.shared(path)
        end = struct.pack("<H", END)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = [i + end for a, b in pieces(texts, 2_000_000) for i in encoder.encode_batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, over all documents. The result is as long as the vocabulary."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for a, b in pieces(ids, 4_000_000):
                total += np.bincount(np.frombuffer(b"".join(ids[a:b]), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    lists, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.r_[coins, packages]
        rank = np.argsort(merged, kind="stable")
        lists.append(rank < len(coins))
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(order) - 2
    for is_coin in reversed(lists):
        coin = int(is_coin[:take].sum())
        out[order[:coin]] += 1
        take = 2 * (take - coin)
    return out


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = self.lengths[order]
        # A canonical code begins where the codes before it, at full width, end.
        width = np.int64(1) << (LIMIT - size)
        begin = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = begin >> (LIMIT - size)
        self.table = np.zeros(1 << LIMIT, np.int32)
        filled = np.repeat(order << 5 | size, width)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        end = np.cumsum(size)
        start = end - size
        bits = int(end[-1]) if len(ids) else 0
        marks = start[::EVERY].astype("<u8")
        words = np.zeros(bits // 32 + 3, np.uint64)
        shift = 64 - (start & 31) - size  # code as the high end of 64 bits from a 32-bit border
        value = self.codes[ids].astype(np.uint64) << shift.astype(np.uint64)
        at = start >> 5
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(ids) else np.zeros(0, np.int64)
        both = np.bitwise_or.reduceat(value, first) if len(ids) else value
        where = at[first]
        words[where] |= both >> np.uint64(32)
        words[where + 1] |= both & np.uint64(0xFFFFFFFF)
        stream = words.astype(">u4").tobytes()
        return b"SSH1" + struct.pack("<QQ", len(ids), len(marks)) + marks.tobytes() + stream

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        """The ids of each block; the lanes of all blocks step together."""
        streams, starts, counts, base = [], [], [], 0
        for p in payloads:
            if p[:4] != b"SSH1":
                raise ValueError("not a block of ids")
            n, marks = struct.unpack_from("<QQ", p, 4)
            starts.append(np.frombuffer(p, "<u8", marks, 20).astype(np.int64) + base * 32)
            counts.append(n)
            stream = np.frombuffer(p, ">u4", offset=20 + 8 * marks)
            streams.append(stream)
            base += len(stream)
        words = np.r_[np.concatenate(streams), np.zeros(2, np.uint32)].astype(np.uint64)
        pos = np.concatenate(starts)
        left = np.concatenate([np.minimum(EVERY, n - EVERY * np.arange(len(s))) for n, s in zip(counts, starts, strict=True)])
        out = np.zeros((len(pos), EVERY), np.uint16)
        mask, cut = np.uint64((1 << LIMIT) - 1), np.uint64(64 - LIMIT)
        for k in range(int(left.max(initial=0))):
            at = pos >> 5
            window = (words[at] << np.uint64(32) | words[at + 1]) >> (cut - (pos & 31).astype(np.uint64)) & mask
            hit = self.table[window.astype(np.int64)]
            out[:, k] = hit >> 5
            pos += np.where(k < left, hit & 31, 0)
        flat, result, lane = out, [], 0
        for n, s in zip(counts, starts, strict=True):
            result.append(flat[lane : lane + len(s)].reshape(-1)[:n])
            lane += len(s)
        return result


BLOCKS = "part int, block int, doc_ids array<long>, sizes array<long>, n long, payload binary"


def write_ids(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store a table (doc_id, ids); gives the two stored tables, codebook and blocks."""
    spark = tokens.sparkSession
    lengths = code_lengths(count_ids(tokens))
    packed = zlib.compress(lengths.tobytes(), 9)
    book = stored(spark.createDataFrame([(bytearray(packed),)], "lengths binary"), "id-codebook")

    def run(batches):
        code = Codebook(np.frombuffer(zlib.decompress(packed), np.uint8))
        part, block = TaskContext.get().partitionId(), 0

        def block_of(docs, ids):
            flat = np.frombuffer(b"".join(ids), "<u2")
            sizes = pa.array([[len(i) // 2 for i in ids]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), sizes, pa.array([len(flat)], pa.int64()), pa.array([code.encode(flat)], pa.binary())], ["part", "block", "doc_ids", "sizes", "n", "payload"])

        docs, ids, n = [], [], 0
        for batch in batches:
            for d, i in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(d), ids.append(i)
                n += len(i) // 2
                if n >= BLOCK:
                    yield block_of(docs, ids)
                    docs, ids, n, block = [], [], 0, block + 1
        if docs:
            yield block_of(docs, ids)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id, null or not, may be any number: a hash of the ids parts them
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc()]
    blocks = tokens.repartitionByRange(width, *order).sortWithinPartitions(*order, "ids").mapInArrow(run, BLOCKS)
    return book, stored(blocks, "id-blocks")


def read_ids(book: DataFrame, blocks: DataFrame) -> DataFrame:
    """(part, block, place, doc_id, ids): the documents of the stored blocks, decoded."""
    packed = bytes(book.first()["lengths"])

    def run(batches):
        code = Codebook(np.frombuffer(zlib.decompress(packed), np.uint8))
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                (ids,) = code.decode([row["payload"]])
                ends = np.cumsum(row["sizes"])
                each = [ids[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
                m = len(each)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * m, pa.int32()), pa.array([row["block"]] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(each, pa.binary())], ["part", "block", "place", "doc_id", "ids"])

    return blocks.mapInArrow(run, "part int, block int, place int, doc_id long, ids binary")


def digests(book: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the stored blocks.

    start comes from the blocks' own counts: their running sum needs one row a
    block, and is taken over parts (as many as the write had tasks) on the driver
    and over the blocks of each part.
    """
    spark = blocks.sparkSession
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in parts])
    offsets = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(parts, before[:-1], strict=True)], "part int, part_start long")
    from pyspark.sql import Window

    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", "n").withColumn("sum", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(F.broadcast(offsets), "part").select("part", "block", (F.col("part_start") + F.col("sum")).alias("block_start"))
    packed = bytes(book.first()["lengths"])

    def run(batches):
        code = Codebook(np.frombuffer(zlib.decompress(packed), np.uint8))
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                (ids,) = code.decode([row["payload"]])
                wide = ids.astype("<u4")
                ends = np.cumsum(row["sizes"])
                begin = np.r_[0, ends[:-1]].astype(np.int64)
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(begin, ends, strict=True)]
                m = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * m, pa.int32()), pa.array([row["block"]] * m, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begin), pa.array(row["sizes"], pa.int64()), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(run, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    """Encode, store in ascending doc_id order, read back: the digest of each document."""
    tokens = stored(encode_ids(docs, path), "ids")
    return digests(*write_ids(tokens))
