"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record is ``length (u64) | masked crc32 of the length | payload | masked crc32 of the payload | newline``, all
little-endian. A mask rotates the checksum by 15 bits and adds a constant, so that a checksum of data that holds
checksums stays sound. The payload is ``flags (u8) | doc_id (i64) | ids``: flag 1 says that ids take 4 bytes and not
2, flag 2 that the id is null. The newline is the record separator of Spark's text writer, which writes the bytes:
so files land in any file system that Spark writes to, appear only when their task commits, and a lost executor
costs a rerun of its tasks only.

Documents are dealt by ranges of ascending doc_id to shards of about ``shard_bytes`` of text; ``file=f/part-k`` is
file f of shard k, so shards and their files in order hold all documents in order. A shard goes on in another file
after ``file_bytes``, so long documents make no file that a task cannot hold. The index is a table beside them with
the offset and length of every record: ``read_at`` reads the records named by it and nothing between them, and
``read_shuffled`` reads all or a stretch of a seeded order in that way.

Defined cases: null text is empty and gives the end id alone; repeated ids and rows keep a record each (ties in
order of the text's hash, repeated rows in no fixed order) and may be dealt to several shards; a null id comes first;
an empty table gives an empty folder and empty results. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.shared import keep, shared_path
from tidemark.llm.codes import bounded, give_back, pieces
from tidemark.llm.decontam import MIX, scramble

MASK_DELTA = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its separator."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return struct.pack("<Bq", wide | (doc_id is None) << 1, doc_id or 0) + ids


def records(data: bytes | pa.Buffer) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """``(offset, length, doc_id, ids)`` of each record; a wrong checksum or a torn record is an error."""
    at, view = 0, memoryview(data)
    data = view
    while at < len(data):
        head = view[at : at + 8]
        if len(data) - at < 12 or masked_crc(head) != struct.unpack_from("<I", data, at + 8)[0]:
            raise ValueError(f"bad record length at byte {at}")
        n = struct.unpack("<Q", head)[0]
        payload = view[at + 12 : at + 12 + n]
        if len(data) < at + 17 + n or masked_crc(payload) != struct.unpack_from("<I", data, at + 12 + n)[0] or data[at + 16 + n] != 10:
            raise ValueError(f"bad record at byte {at}")
        flags, doc_id = struct.unpack_from("<Bq", payload)
        yield at, n + 17, None if flags & 2 else doc_id, np.frombuffer(payload, "<u4" if flags & 1 else "<u2", offset=9)
        at += n + 17


class Encoder:
    """Ids of whole texts as bytes. With ``by_word``, for tokenizers that part words at white space and never join what
    it parts, words are looked up, many at once, in a bounded hash table of words met before, and only new words go to
    the library. The key of a word is the word itself (15 bytes and its length in two numbers), so the table is exact;
    longer words are kept in a small dictionary, very long ones not at all."""

    SLOTS, MOST, LONG = 1 << 20, 800_000, 20_000  # slots of the table; words at which it starts anew, and long ones
    PORTION = 1 << 18  # bytes looked up together; they hold far fewer new words than the table has free slots
    ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")  # what may be a special token; white space to Python alone
    SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    BLANK = re.compile(rb"[ \t-\r]")
    PROBES = ("a", "été", "the", "zyxwvutsrqponmlkjihgfedcba", "ÿþýüûú", "straße", "µªº", "øåæð")

    def __init__(self, path: str, by_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel; threads of its own only cost memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.model = self.tokenizer.model
        self.wide = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) >= 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.blank = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
        self.mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = (c for c in map(chr, range(0x80, 0x100)) if c.isalpha())
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}  # how the model spells them
        self.forget()
        # the model alone must give what the whole chain gives for lower-case letters; else every word takes the chain
        self.direct = by_word and all(self.model_ids(w) == self.chain_ids(w) for w in self.PROBES)
        give_back()

    def forget(self) -> None:
        self.low, self.high = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.value = np.full(self.SLOTS, -1, np.int64)  # offset of the ids << 8 | how many
        self.ids, self.filled, self.words, self.long = np.zeros(1 << 16, self.kind), 0, 0, {}

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))]

    def chain_ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def chain_ids_of(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def parts(self, words: list[str]) -> list[tuple[str, str] | None]:
        """Words of Latin-1 letters (their normal form is themselves, each lower case one letter) and a mark behind them."""
        out: list[tuple[str, str] | None] = []
        for w in words:
            base, tail = (w[:-1], w[-1]) if w[-1] in ".," else (w, "")
            letters = self.direct and base.isalpha() and (base.isascii() or max(base) < "\u0100")
            out.append((base.lower(), tail) if letters else None)
        return out

    # the table

    def keys(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of at most 15 bytes; behind the data lie 16 bytes more."""
        at = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        high = at[starts + 8] & self.mask[np.maximum(size - 8, 0)]
        return at[starts] & self.mask[np.minimum(size, 8)], high | size.astype(np.uint64) << np.uint64(56)

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (scramble(low * MIX[2] ^ high * MIX[3]) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of words, -1 for those not in the table."""
        slot = self.slots(low, high)
        value = self.value[slot]
        todo = np.flatnonzero((value >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(todo):  # another word is there: look on
            slot[todo] = s = slot[todo] + 1 & self.SLOTS - 1
            value[todo] = v = self.value[s]
            todo = todo[(v >= 0) & ((self.low[s] != low[todo]) | (self.high[s] != high[todo]))]
        return value

    def insert(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Different words, none of which is in the table."""
        slot, todo = self.slots(low, high), np.arange(len(low))
        self.words += len(low)
        while len(todo):
            free = todo[self.value[slot[todo]] < 0]
            self.value[slot[free]] = free  # of several that want one slot the last has it
            won = free[self.value[slot[free]] == free]
            s = slot[won]
            self.low[s], self.high[s], self.value[s] = low[won], high[won], value[won]
            placed = np.zeros(len(low), bool)
            placed[won] = True
            todo = todo[~placed[todo]]
            slot[todo] = slot[todo] + 1 & self.SLOTS - 1

    def add_ids(self, ids: list[list[int]]) -> np.ndarray:
        """Where ids now lie: their values."""
        count = np.array([len(x) for x in ids], np.int64)
        end = self.filled + np.cumsum(count)
        flat = np.fromiter(chain.from_iterable(ids), self.kind, int(count.sum()))
        if self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.filled], np.zeros(self.filled + 2 * len(flat), self.kind)))
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        return end - count << 8 | count

    def listed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        return self.keys(np.frombuffer(b"".join(words) + bytes(16), np.uint8), np.cumsum(size) - size, size)

    def learn(self, words: list[bytes]) -> None:
        """Put new words of at most 15 bytes into the table: first those that are others' lower case, then the others."""
        texts = b" ".join(words).decode().split(" ")
        split = self.parts(texts)
        bases = list(dict.fromkeys(x[0] for x in split if x))
        known: dict[str, list[int]] = {}
        if bases:
            low, high = self.listed([w.encode() for w in bases])
            value = self.find(low, high)
            known = {w: self.ids[v >> 8 : (v >> 8) + (v & 255)].tolist() for w, v in zip(bases, value.tolist()) if v >= 0}
            made = {w: self.model_ids(w) for w, v in zip(bases, value.tolist()) if v < 0}
            new = value < 0
            self.insert(low[new], high[new], self.add_ids(list(made.values())))
            known |= made
        tails = {"": [], ".": self.chain_ids("."), ",": self.chain_ids(",")}
        rest = [i for i, (t, x) in enumerate(zip(texts, split)) if not x or x[0] != t]
        others = iter(self.chain_ids_of([texts[i] for i in rest if not split[i]]))
        if rest:
            self.insert(*self.listed([words[i] for i in rest]), self.add_ids([known[x[0]] + tails[x[1]] if (x := split[i]) else next(others) for i in rest]))

    def long_words(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Offset and number of the ids of each."""
        new = list(dict.fromkeys(w for w in words if w not in self.long))
        texts = [w.decode() for w in new]
        others = self.chain_ids_of(texts)
        made = {}
        for w, ids in zip(new, others):
            made[w] = self.filled, len(ids)
            self.add_ids([ids])
        found = [self.long.get(w) or made[w] for w in words]
        self.long |= {w: x for w, x in made.items() if len(w) <= 64}
        return found

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that begin and end between words."""
        if self.words > self.MOST or len(self.long) > self.LONG or self.filled > 16 * self.MOST:
            self.forget()
        data = np.frombuffer(b"".join((b" ", b" ".join(parts), b" ", bytes(16))), np.uint8)
        blank = self.blank[data[:-16]]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        size = ends - starts
        value = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= 15)
        low, high = self.keys(data, starts[short], size[short])
        value[short] = self.find(low, high)
        unknown = short[value[short] < 0]
        if len(unknown):
            whole = data.tobytes()
            self.learn(list(dict.fromkeys(whole[a:z] for a, z in zip(starts[unknown].tolist(), ends[unknown].tolist()))))
            value[unknown] = self.find(*self.keys(data, starts[unknown], size[unknown]))
        offset, count = value >> 8, value & 255
        if len(long := np.flatnonzero(size > 15)):
            found = self.long_words([data[a:z].tobytes() for a, z in zip(starts[long].tolist(), ends[long].tolist())])
            offset[long], count[long] = [x[0] for x in found], [x[1] for x in found]
        reach = np.r_[0, np.cumsum(count)]
        ids = self.ids[np.repeat(offset - reach[:-1], count) + np.arange(reach[-1])]
        # the number of words before each part gives the number of ids before it
        begin = np.cumsum([1, *(len(p) + 1 for p in parts)])
        cut = reach[np.searchsorted(starts, begin)]
        raw, width = ids.tobytes(), ids.itemsize
        return [raw[width * a : width * z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def cuts(self, data: bytes) -> Iterator[bytes]:
        at = 0
        while len(data) - at > self.PORTION and (blank := self.BLANK.search(data, at + self.PORTION)):
            yield data[at : blank.start()]
            at = blank.start()
        yield data[at:]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.plain(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []

        def done() -> None:
            for (i, _), x in zip(held, self.encode_parts([p for _, p in held])):
                out[i].append(x)
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            if any(x in t for x in self.ODD):
                out[i] = self.plain([t])
                continue
            for p in self.cuts((t if t.isascii() else self.SPACES.sub(" ", t)).encode()):
                if held and size + len(p) > self.PORTION:
                    done()
                    size = 0
                held.append((i, p))
                size += len(p)
        done()
        return [b"".join(x) for x in out]


ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    """One for each Python worker: what it has learnt serves later tasks."""
    if (path, by_word) not in ENCODERS:
        ENCODERS[path, by_word] = Encoder(path, by_word)
    return ENCODERS[path, by_word]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, by_word: bool = False, shard_bytes: int = 8 << 20, file_bytes: int = 256 << 20) -> str:
    """Write records to ``path/records`` and their index to ``path/index``; returns ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # the hash and a drawn number part rows of one id, so that no range must hold them all
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("drawn")]
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.rand(7).alias("drawn"))
    dealt = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, by_word)
        end = np.array([end_id], enc.kind).tobytes()
        file = size = at = 0
        for b in pieces(batches, 64):
            found, files = enc(b.column("text").to_pylist()), []
            out = [frame(pack(i, x + end, enc.wide)) for i, x in zip(b.column("doc_id").to_pylist(), found)]
            for x in out:
                if size and size + len(x) > file_bytes:  # a shard that has grown too large goes on in another file
                    file, size = file + 1, 0
                size += len(x) + 1
                files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(range(at, at + len(out)), pa.int64()), pa.array(out, pa.binary())], ["file", "at", "record"])
            at += len(out)

    framed = bounded(dealt).mapInArrow(encode, "file int, at long, record binary").sortWithinPartitions("file", "at")
    framed.select("file", F.col("record").cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\n").text(f"{path}/records")
    read_records(docs.sparkSession, path).select("shard", "file", "record", "offset", "length", "doc_id", "n_tokens", "start_in_file").write.parquet(f"{path}/index")
    return path


PLACE = (r"/file=(\d+)/part-(\d+)", 2, 1)  # of a path: its shard and its file within the shard


def contents(spark: SparkSession, paths: str, what: str = "content") -> DataFrame:
    """``(shard, file, content)`` of record files; with ``what="path"`` their paths, and no file is opened."""
    pattern, shard, file = PLACE
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(paths).filter(F.col("length") > 0)
    return files.select(F.regexp_extract("path", pattern, shard).cast("int").alias("shard"), F.regexp_extract("path", pattern, file).cast("int").alias("file"), what)


def batch_of(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, file, record, offset, length, doc_id, n_tokens, start_in_file, ids_crc32)``: all files, parsed from end to end."""
    schema = "shard int, file int, record long, offset long, length long, doc_id long, n_tokens long, start_in_file long, ids_crc32 long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ENCODERS.clear()  # what was learnt for writing is not needed next to the files
        give_back()
        for b in pieces(batches, 1):
            start, out = 0, []
            place = b.column("shard")[0].as_py(), b.column("file")[0].as_py()
            for k, (at, n, doc_id, ids) in enumerate(records(b.column("content")[0].as_buffer())):
                out.append((*place, k, at, n, doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(out) == 2048:
                    yield batch_of(out, schema)
                    out = []
            yield batch_of(out, schema)

    return bounded(contents(spark, f"{path}/records")).mapInArrow(parse, schema)


def opener(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of a path as tasks open it, and the path in it; None where only Spark's readers can."""
    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ImportError):
        return None


def records_at(handle: pa.NativeFile, found: list[dict]) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """``(position, doc_id, ids)`` of records; only their own bytes are read, in order of their offsets."""
    for x in sorted(found, key=lambda x: x["offset"]):
        ((_, _, doc_id, ids),) = records(handle.read_at(x["length"], x["offset"]))
        yield x["position"], doc_id, ids


def read_at(spark: SparkSession, path: str, wanted: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """``(position, doc_id, ids)`` of the records of ``wanted(position, shard, file, offset, length)``.

    A task opens the files that hold any and reads the bytes of the records, nothing between them; the list of files
    is a table and never on the driver. Where tasks can't open the store themselves, Spark's reader gives them whole
    files. Up to ``most_broadcast`` records (some 40 bytes each) go to the tasks that read files; more are joined.
    """
    wanted = keep(wanted.select("position", "shard", "file", "offset", "length"), "wanted-records")
    places = wanted.groupBy("shard", "file").agg(F.collect_list(F.struct("position", "offset", "length")).alias("found"))
    small = wanted.limit(most_broadcast + 1).count() <= most_broadcast
    direct = opener(path) is not None
    met = contents(spark, f"{path}/records", "path" if direct else "content").join(F.broadcast(places) if small else places, ["shard", "file"])
    schema = "position long, doc_id long, ids array<int>"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            if direct:
                store, at = opener(b.column("path")[0].as_py())
                handle = store.open_input_file(at)
            else:
                handle = pa.BufferReader(b.column("content")[0].as_buffer())
            with handle:
                out = []
                for position, doc_id, ids in records_at(handle, b.column("found")[0].as_py()):
                    out.append((position, doc_id, ids.astype(np.int32)))
                    if len(out) == 2048:
                        yield batch_of(out, schema)
                        out = []
                yield batch_of(out, schema)

    return bounded(met.select("path" if direct else "content", "found")).mapInArrow(fetch, schema)


def starts(index: DataFrame) -> DataFrame:
    """``(shard, file, file_start)``: ids in all earlier files; one row for each file goes through the window."""
    totals = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", "file", F.coalesce(F.sum("n").over(W.orderBy("shard", "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))


def read_shuffled(spark: SparkSession, path: str, seed: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """``(position, doc_id, ids)`` in a seeded order: each record has a position, a hash of seed and place, and those
    from ``first`` to ``last`` (both included; default: all) are looked up in the index and read by their offsets."""
    placed = spark.read.parquet(f"{path}/index").withColumn("position", F.xxhash64(F.lit(seed), "shard", "file", "record"))
    for bound, inside in ((first, F.col("position") >= F.lit(first)), (last, F.col("position") <= F.lit(last))):
        placed = placed if bound is None else placed.filter(inside)
    return read_at(spark, path, placed).orderBy("position", "doc_id")


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the files."""
    before = starts(spark.read.parquet(f"{path}/index"))
    return read_records(spark, path).join(before, ["shard", "file"]).select("doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def encoded_rows(docs: DataFrame, tokenizer: str | None = None, by_word: bool = True) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    return token_rows(spark, write_tokens(docs, shared_path(spark, "tokens"), str(tokenizer), by_word=by_word))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
