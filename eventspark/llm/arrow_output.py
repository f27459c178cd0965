"""Token ids in Arrow files of fixed-size-list batches.

Documents are range-partitioned by id, encoded with the ``tokenizers``
library and packed one after another, each followed by the end id, into
sequences of equal length. A shard is an Arrow IPC file with the columns
``ids`` and ``mask`` (fixed-size lists); every batch but the last holds the
same number of sequences, so a sequence's place in the file follows from its
number, and a reader that maps the file into memory gets it without a copy.
Only the last sequence of a shard is padded (id 0, mask 0).

Each task attempt writes files under names of its own; the index, a Parquet
table that Spark commits, names the files that count. A lost executor or a
repeated attempt leaves at most files that nothing refers to.

Encoding: a text is cut only where the byte-level pre-tokeniser must end a
token, whatever stands around: before white space that follows a letter, digit
or mark, and where letters, digits and marks meet (never after an apostrophe,
never next to a character outside ASCII and the Latin-1 letters), and around the
literals of the vocabulary's added tokens, such as <|endoftext|>, which the
library takes out of a text before all else: a literal is one uncut piece and
gets the added token's id. A text with the literal of an added token that looks
at its surroundings (``lstrip``, ``rstrip``, ``single_word``) is not cut at all.
A piece then has the same ids anywhere, so each worker lets the library encode a
distinct piece once, and keeps at most ``KNOWN_PIECES`` of them (found by a hash,
and compared by their bytes). These rules are those of a byte-level BPE file
without prefix space, normaliser, dropout or truncation; texts are handed to the
library whole if the file says anything else.

Rows: a null text is empty (only the end id). A null id comes first. Rows that
repeat an id stand in the order of their texts' hash. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace, text_docs

SEQUENCE = 2048
#: Sequences in a batch, and tokens after which the next document opens a new shard.
BATCH_SEQUENCES, SHARD_TOKENS = 256, 1 << 23
KNOWN_PIECES, ENCODE_AT_ONCE = 1 << 20, 1 << 13
END_ID = 0

# Classes of bytes: 0 unknown, 1 letter, 2 digit, 3 mark, 4 white space, 5 apostrophe.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x27] = 5
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4


class AddedTokens:
    """Finds the spans that stay whole because of added tokens."""

    def __init__(self, tokens: list):
        self.literals = [t.content.encode() for t in tokens if t.content]
        alone = [t for t in tokens if t.content and not (t.lstrip or t.rstrip or t.single_word)]
        self.rooted = [t.content.encode() for t in tokens if t.content and (t.lstrip or t.rstrip or t.single_word)]
        # as the library: those of the plain text first, the leftmost longest of each kind
        kinds = ([t.content.encode() for t in alone if t.normalized == n] for n in (False, True))
        self.patterns = [re.compile(b"|".join(re.escape(x) for x in sorted(k, key=len, reverse=True))) for k in kinds if k]

    def _in_text(self, raw: bytes, start: int, end: int) -> list[tuple[int, int]]:
        if any(raw.find(x, start, end) >= 0 for x in self.rooted):
            return [(start, end)]
        found, gaps = [], [(start, end)]
        for pattern in self.patterns:
            rest = []
            for a, b in gaps:
                for m in pattern.finditer(raw, a, b):
                    found.append(m.span())
                    rest.append((a, m.start()))
                    a = m.end()
                rest.append((a, b))
            gaps = rest
        return found

    def spans(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        if not any(x in raw for x in self.literals):
            return []
        edges = offsets.tolist()
        return [s for a, b in zip(edges[:-1], edges[1:]) for s in self._in_text(raw, a, b)]


def piece_bounds(data: np.ndarray, offsets: np.ndarray, whole: list[tuple[int, int]] = ()) -> np.ndarray:
    """Where pieces start, and the end of the data; every text starts one, and
    every span of ``whole`` is one."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # no letters: times and division signs
    kind[lead] = kind[lead + 1] = 1
    group = np.where(kind == 5, 3, kind)
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, dtype=bool)
    meets = (before != 5) & (after > 0) & (group[:-1] != group[1:])
    cut[1:-1] = (before > 0) & (before != 4) & ((after == 4) | meets)
    for a, b in whole:
        cut[a + 1: b] = False
        cut[a] = cut[b] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


def cuts_like_gpt(settings: dict) -> bool:
    """Whether a tokenizer file cuts and encodes as ``piece_bounds`` assumes."""
    cutter, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    return (cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) is True
            and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
            and not any(settings.get(k) for k in ("normalizer", "truncation", "padding")))


class Encoder:
    """Ids of texts, through the library, with a bounded table of known pieces."""

    def __init__(self, tokenizer_path: str, most: int = KNOWN_PIECES):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            self.cuts = cuts_like_gpt(json.load(f))
        self.salt = 0
        self.added = AddedTokens(list(self.tokenizer.get_added_tokens_decoder().values()))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, K.U64)
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, self.dtype)
        self.pieces = pa.array([], pa.large_binary())
        self.row_of = np.empty(0, np.int64)  # which of the pieces a key stands for

    def _learn(self, keys: np.ndarray, found_pieces: pa.Array) -> None:
        pieces = [x.decode("utf-8", "replace") for x in found_pieces.to_pylist()]
        ids, count = [self.ids], []
        for i in range(0, len(pieces), ENCODE_AT_ONCE):  # the library's results are large
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i: i + ENCODE_AT_ONCE], add_special_tokens=False)]
            count.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((i for x in found for i in x), self.dtype, int(count[-1].sum())))
        count = np.concatenate(count)
        first = len(self.ids) + np.cumsum(count) - count
        self.row_of = np.concatenate([self.row_of, len(self.pieces) + np.arange(len(pieces))])
        self.pieces = pa.concat_arrays([self.pieces, found_pieces])
        self.ids = np.concatenate(ids)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.row_of = keys[order], self.row_of[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts together, and how many each text has."""
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(n, np.int64)
        raw = data.tobytes()
        bounds = piece_bounds(data, offsets, self.added.spans(raw, offsets)) if self.cuts else np.unique(offsets)
        start = bounds[:-1]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        which, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        own, ends = K.string_buffers(distinct)
        keys = K.span_codes(own, ends[:-1], ends[1:], K.BYTE_CODES if not self.salt else K.mix64(K.BYTE_CODES + K.U64(self.salt)))
        if len(self.keys) + len(keys) > self.most:
            self.forget()
        row = np.searchsorted(self.keys, keys)
        unknown = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            near = np.minimum(row, len(self.keys) - 1)
            unknown = self.keys[near] != keys
        known = ~unknown
        clash = len(np.unique(keys[unknown])) < unknown.sum() or (
            known.any() and not pc.all(pc.equal(self.pieces.take(pa.array(self.row_of[row[known]])), distinct.filter(pa.array(known)))).as_py())
        if clash:  # two pieces under one hash: begin again with another
            self.salt += 1
            self.forget()
            return self.encode(data, offsets)
        if unknown.any():
            self._learn(keys[unknown], distinct.filter(pa.array(unknown)))
            row = np.searchsorted(self.keys, keys)
        first, count = self.first[row][which], self.count[row][which]
        total = np.cumsum(count)
        ids = self.ids[np.arange(total[-1]) + np.repeat(first - (total - count), count)]
        text = np.searchsorted(offsets, start, side="right") - 1
        return ids, np.bincount(text, weights=count, minlength=n).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_path: str) -> Encoder:
    """One encoder per worker process; its known pieces serve later tasks too."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Encoder(tokenizer_path)
    return _encoders[tokenizer_path]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), unquote("/" + uri[5:].lstrip("/"))
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Packs ids into the sequences of one Arrow file after another."""

    def __init__(self, folder: str, name: str, dtype, sequence: int, shard_tokens: int = SHARD_TOKENS):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.sequence, self.number, self.file = name, sequence, -1, None
        self.shard_tokens = shard_tokens
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.full = sequence * BATCH_SEQUENCES
        self.buffer, self.filled = np.zeros(self.full, dtype), 0

    def add(self, ids: np.ndarray) -> tuple[str, int]:
        """Write one document; returns its shard and its place there."""
        if self.file is None or self.tokens >= self.shard_tokens:
            self.close()
            self.number, self.tokens, self.filled = self.number + 1, 0, 0
            self.shard = f"{self.name}-{self.number:04d}.arrow"
            self.stream = self.fs.open_output_stream(f"{self.folder}/{self.shard}")
            self.file = pa.ipc.new_file(self.stream, self.schema)
        at, done = self.tokens, 0
        while done < len(ids):
            n = min(len(ids) - done, self.full - self.filled)
            self.buffer[self.filled: self.filled + n] = ids[done: done + n]
            self.filled, done = self.filled + n, done + n
            if self.filled == self.full:
                self._batch()
        self.tokens += len(ids)
        return self.shard, at

    def _batch(self) -> None:
        rows = -(-self.filled // self.sequence)
        self.buffer[self.filled:] = 0
        mask = np.arange(rows * self.sequence) < self.filled
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[: rows * self.sequence]), self.sequence) for x in (self.buffer, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.filled = 0

    def close(self) -> None:
        if self.file is not None:
            if self.filled:
                self._batch()
            self.file.close()
            self.stream.close()
            self.file = None


def _write(folder: str, tokenizer_path: str, sequence: int, end_id: int, shard_tokens: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer_path)
        out = ShardWriter(folder, f"part-{part:06d}-{uuid.uuid4().hex[:12]}", encode.dtype, sequence, shard_tokens)
        so_far = 0
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.slices(offsets, 1 << 21):
                ids, count = encode.encode(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                upto = np.cumsum(count)
                rows = [out.add(np.append(ids[upto[d] - count[d]: upto[d]], np.array(end_id, encode.dtype))) for d in range(j - i)]
                n = count + 1
                start = so_far + np.cumsum(n) - n
                so_far += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.full(j - i, part), pa.int32()), pa.array(start, pa.int64()),
                     pa.array(n, pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                    names=["doc_id", "part", "part_start", "n_tokens", "shard", "place"])
        out.close()
    return run


_INDEX = "doc_id long, part int, part_start long, n_tokens long, shard string, place long"


def write(spark: SparkSession, docs: DataFrame, ws: Workspace, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
          shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards below ``ws.path("shards")``; returns the index
    (doc_id, start, n_tokens, shard, place)."""
    ordered = (text_docs(docs).withColumn("key", F.xxhash64("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("key")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key"))
    index = ws.save(ordered.select("doc_id", "text").mapInArrow(_write(ws.path("shards"), tokenizer_path, sequence, end_id, shard_tokens), _INDEX), "index")
    # one number for each partition
    totals = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    starts = F.broadcast(spark.createDataFrame(rows, "part int, base long"))
    return index.join(starts, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "shard", "place")


class Shard:
    """Random access to one file; local files are mapped, not read."""

    def __init__(self, folder: str, name: str):
        fs, path = filesystem(folder)
        path = f"{path}/{name}"
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence ``i``; the ids are a view of the file."""
        batch, at = self.reader.get_batch(i // self.per_batch), i % self.per_batch
        cut = slice(at * self.sequence, (at + 1) * self.sequence)
        return (batch.column("ids").flatten().to_numpy(zero_copy_only=True)[cut],
                batch.column("mask").flatten().to_numpy(zero_copy_only=False)[cut])

    def tokens(self, place: int, n: int) -> np.ndarray:
        """``n`` ids from a place, over as many batches as they span."""
        per, out = self.per_batch * self.sequence, []
        while n > 0:
            ids = self.reader.get_batch(place // per).column("ids").flatten().to_numpy(zero_copy_only=True)
            got = ids[place % per: place % per + n]
            out.append(got)
            place, n = place + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out)


def _read(folder: str):
    def run(batches):
        name, shard = None, None
        for batch in batches:
            names, places, counts = (batch.column(c).to_pylist() for c in ("shard", "place", "n_tokens"))
            n, crc = [], []
            for s, place, count in zip(names, places, counts):
                if s != name:
                    name, shard = s, Shard(folder, s)
                ids = shard.tokens(place, count)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files, read every document back from them: doc_id, start,
    n_tokens, ids_crc32."""
    ws = Workspace(spark, "arrow-output")
    index = write(spark, docs, ws, tokenizer_path, **options)
    by_shard = index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "place")
    return by_shard.mapInArrow(_read(ws.path("shards")), "doc_id long, start long, n_tokens long, ids_crc32 long")
