"""Operator 13: token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped.

A folder of token files holds, for each file number f:

  tokens-f.bin   the ids of its documents one after the other, little-endian unsigned 16-bit integers (32-bit where the
                 vocabulary needs them), each document closed by the end id
  tokens-f.off   little-endian unsigned 64-bit integers: the position in tokens-f.bin at which each document begins, and
                 the number of ids
  tokens-f.doc   the documents' own ids, an Arrow file

and manifest/, a Parquet table with a row for each file: file, documents, tokens, first_document, first_token, dtype. The
last but one are the file's bases: sums over all files before it, so base + offset is a position in the whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, staged

#: Letters that end or begin a piece, and bytes of theirs in UTF-8; every other character of a text in ASCII and these is none.
LETTERS = "A-Za-zÀ-ÖØ-öø-ƿ"
LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])
#: A letter after one of these belongs to the same piece.
STICKY = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r'"))
OTHER = re.compile(r"[^\x00-\x7f\xc0-ƿ]")
#: Before a blank that follows a visible character a byte-level tokenizer always cuts, whatever stands around.
SAFE_CUT = re.compile(r"(?<=[!-~À-ƿ])(?= )")
CHUNK_CHARS = 1 << 14
#: Pieces of visible characters and blanks that stay apart from line breaks around them.
LINE = re.compile(r" ?[!-~À-ƿ](?:[\t\x20-~À-ƿ]*[!-~À-ƿ])?")
LINES_AT_ONCE = 1 << 14
#: A worker remembers so many pieces of at most so many bytes.
KEPT_PIECES, KEPT_BYTES = 1_000_000, 48
#: Texts are encoded in groups of about so many characters, longer ones in parts.
GROUP_CHARS = 1 << 21
#: Of hashes of pieces: prefix sums of bytes times powers of an odd number.
ODD = 0x9E3779B97F4A7C15


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts in data begin, of which each begins at one of `begins`.

    A byte-level tokenizer encodes each alike alone and in its text: a word with the one blank before it; or what stands
    between words, with the word after it where a line break or an apostrophe touches that.
    """
    letter = LETTER[data]
    signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # the signs × and ÷
    letter[signs] = letter[signs + 1] = False
    first = np.zeros(len(data), bool)
    first[begins[begins < len(data)]] = True
    at = np.flatnonzero(np.concatenate(([True], letter[1:] != letter[:-1])) | first)
    word = letter[at] & ~first[at]
    before = data[at - 1]
    at = (at - (word & (before == 0x20)))[~(word & STICKY[before])]
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


class Encoder:
    """A tokenizer of the tokenizers library that encodes each piece of text once as long as it is remembered.

    Byte-level tokenizers encode the pieces of a text (see piece_starts; for texts with other characters, stretches between
    SAFE_CUTs) by themselves, with the same ids as the whole text. Pieces of a group are told apart by hashes, which are
    confirmed byte by byte, so that each is looked up once. When KEPT_PIECES are remembered, new ones are not kept; when most
    of a group are new, it begins anew. Texts that hold an added token, and all texts of other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in made["added_tokens"]]
        self.by_piece = not any("\n" in a for a in self.added) and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not made.get("normalizer") and not made["model"].get("dropout")
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept: dict[bytes, bytes] = {}
        self.stale = False
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def power(self, n: int) -> list[np.ndarray]:
        """The first n powers of ODD and of its inverse."""
        if len(self.powers[0]) < n:
            self.powers = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(2 * n, x, np.uint64)))) for x in (ODD, pow(ODD, -1, 1 << 64))]
        return self.powers

    def parts(self, text: str) -> list[str]:
        """The text itself, or where it is long, parts of it that a tokenizer parts too."""
        out, at = [], 0
        while len(text) - at > GROUP_CHARS and (m := SAFE_CUT.search(text, at + GROUP_CHARS // 2)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]] if at else [text]

    def stretches(self, text: str) -> list[str]:
        if not self.by_piece or any(a in text for a in self.added):
            return [text]
        out, at = [], 0
        while m := SAFE_CUT.search(text, at + CHUNK_CHARS):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that are not remembered. Many lines go in one text, parted at the ids of their breaks, since a call for each costs more than the encoding."""
        out, alone = {}, pieces
        if self.by_piece and len(self.line_break) == 1:
            alone, lines = [], []
            for p in pieces:
                (lines if len(p) <= KEPT_BYTES and (p.isalpha() or p[1:].isalpha() and p[0] == " " or LINE.fullmatch(p)) else alone).append(p)
            for lo in range(0, len(lines), LINES_AT_ONCE):
                part = lines[lo : lo + LINES_AT_ONCE]
                ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.dtype)
                ends = np.append(np.flatnonzero(ids == self.line_break[0]), len(ids)) * self.dtype.itemsize
                data, at, starts = ids.tobytes(), ends.tolist(), [0, *(ends[:-1] + self.dtype.itemsize).tolist()]
                out.update((p, data[i:j]) for p, i, j in zip(part, starts, at, strict=True))
        for lo in range(0, len(alone), 4096):
            part = alone[lo : lo + 4096]
            out.update((p, np.array(e.ids, self.dtype).tobytes()) for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        return out

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that have no other letters and no added token."""
        coded = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        whole = b"".join(coded)
        if not whole:
            return [b""] * len(texts)
        data, ends = np.frombuffer(whole, np.uint8), np.cumsum(sizes)
        starts = piece_starts(data, ends - sizes)
        stops = np.append(starts[1:], len(data))
        up, down = self.power(len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
        key = (sums[stops] - sums[starts]) * down[starts]
        _, index, which = np.unique(key, return_index=True, return_inverse=True)
        shift = np.repeat(starts[index][which] - starts, stops - starts)
        if not np.array_equal((stops - starts)[index][which], stops - starts) or not np.array_equal(data[np.arange(len(data)) + shift], data):
            return [x for t in texts for x in (self.by_pieces([t]) if len(texts) > 1 else [self.alone(t)])]  # two pieces of one hash
        if self.stale:
            self.kept, self.stale = {}, False
        known, unique = self.kept, [whole[i:j] for i, j in zip(starts[index].tolist(), stops[index].tolist(), strict=True)]
        found = list(map(known.get, unique))
        new = [k for k, x in enumerate(found) if x is None]
        fresh = self.fresh([unique[k].decode() for k in new])
        full = len(known) + len(new) > KEPT_PIECES
        for k in new:
            found[k] = fresh[unique[k].decode()]
            if not full and len(unique[k]) <= KEPT_BYTES:
                known[unique[k]] = found[k]
        self.stale = full and 2 * len(new) > len(unique)  # what is remembered is of little use here
        ids, many = np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        first, here = (np.cumsum(many) - many)[which], many[which]
        upto = np.cumsum(here)
        tokens = ids[np.arange(upto[-1]) + np.repeat(first - (upto - here), here)]
        cuts = np.concatenate(([0], upto))[np.searchsorted(starts, np.append(ends - sizes, len(data)))]
        return [tokens[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def alone(self, text: str) -> bytes:
        """The ids of a text that is not cut into words."""
        pieces = self.stretches(text)
        ids = self.fresh([*dict.fromkeys(pieces)])
        return b"".join(map(ids.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of dtype."""
        out: list = [None] * len(texts)
        plain, owner = [], []
        for k, t in enumerate(texts):
            if self.by_piece and not OTHER.search(t) and not any(a in t for a in self.added):
                for part in self.parts(t):
                    plain.append(part)
                    owner.append(k)
            else:
                out[k] = self.alone(t)
        lo = 0
        while lo < len(plain):
            hi, chars = lo, 0
            while hi < len(plain) and (hi == lo or chars + len(plain[hi]) <= GROUP_CHARS):
                chars += len(plain[hi])
                hi += 1
            for k, ids in zip(owner[lo:hi], self.by_pieces(plain[lo:hi]), strict=True):
                out[k] = ids if out[k] is None else out[k] + ids
            lo = hi
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker, which many tasks share."""
    return Encoder(path)


def place(uri: str):
    """A file system that pyarrow knows and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":" in uri else f"file://{os.path.abspath(uri)}")


def opened(uri: str):
    """The file to read parts of, memory-mapped where its file system is mounted."""
    import pyarrow as pa
    from pyarrow.fs import LocalFileSystem

    fs, path = place(uri)
    return pa.memory_map(path) if isinstance(fs, LocalFileSystem) else fs.open_input_file(path)


def numbers(source, dtype, first: int, n: int) -> np.ndarray:
    """n integers from the first-th on; of a memory-mapped file a view, no copy."""
    width = np.dtype(dtype).itemsize
    source.seek(first * width)
    return np.frombuffer(source.read_buffer(n * width), dtype)


def file_name(path: str, file: int, kind: str) -> str:
    return f"{path}/tokens-{file:06d}.{kind}"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token files of docs under path, a folder that driver and executors share, in order of id (nulls first); gives the manifest.

    tokenizer: a file of the tokenizers library, on every machine; its special tokens are not added. Null and empty texts
    have the end id alone. Rows of one id stand in order of a hash of their texts, rows alike in both either way round.
    Of an empty docs there are no files and an empty manifest. Other columns do not matter.

    One range shuffle deals the texts out; each task encodes its range in groups and writes it to files of its own as it
    goes, under a name of the attempt that is changed to the final one at the end, so a task that is run again or twice
    leaves one whole file. The bases come from a prefix sum over one row for each file.
    """
    spark = docs.sparkSession
    dtype = encoder(tokenizer).dtype.str

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context, encode = TaskContext.get(), encoder(tokenizer).encode
        file, (fs, root) = context.partitionId(), place(path)
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        own = {k: f"{file_name(root, file, k)}.{context.taskAttemptId()}" for k in ("bin", "off", "doc")}
        sinks, names, documents, tokens = {}, None, 0, 0
        for b in batches:
            if not sinks:
                fs.create_dir(root, recursive=True)
                sinks = {k: fs.open_output_stream(p) for k, p in own.items()}
                names = pa.ipc.new_file(sinks["doc"], pa.schema([b.schema.field(0)]))
                sinks["off"].write(np.zeros(1, "<u8").tobytes())
            group, chars = [], 0
            for k in range(b.num_rows):
                group.append(b.column(1)[k].as_py() or "")
                chars += len(group[-1])
                if chars < GROUP_CHARS and k + 1 < b.num_rows:
                    continue
                sizes = []
                for ids in encode(group):
                    sinks["bin"].write(ids)
                    sinks["bin"].write(end)
                    sizes.append(len(ids) // width + 1)
                ends = np.cumsum(np.array(sizes, "<u8")) + np.uint64(tokens)
                sinks["off"].write(ends.astype("<u8").tobytes())
                tokens, group, chars = int(ends[-1]), [], 0
            names.write_batch(pa.RecordBatch.from_arrays([b.column(0)], schema=pa.schema([b.schema.field(0)])))
            documents += b.num_rows
        if sinks:
            names.close()
            for k, sink in sinks.items():
                sink.close()
                fs.move(own[k], file_name(root, file, k))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.int32()), (documents, pa.int64()), (tokens, pa.int64()))], names=["file", "documents", "tokens"])

    by = [F.col("id").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(max(1, partitions(spark)), *by).sortWithinPartitions(*by).select("id", "text")
    files = sorted(tuple(r) for r in staged(rows.mapInArrow(write, "file int, documents long, tokens long")).collect())  # a row for each file
    out, first_document, first_token = [], 0, 0
    for file, documents, tokens in files:
        out.append((file, documents, tokens, first_document, first_token, dtype))
        first_document, first_token = first_document + documents, first_token + tokens
    spark.createDataFrame(out, "file int, documents long, tokens long, first_document long, first_token long, dtype string").coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def checksum(source, dtype: str, lo: int, hi: int, at_once: int = 1 << 20) -> int:
    """CRC-32 of the ids from lo to hi as little-endian unsigned 32-bit integers."""
    out = 0
    for k in range(lo, hi, at_once):
        out = zlib.crc32(numbers(source, dtype, k, min(at_once, hi - k)).astype("<u4"), out)
    return out


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the token files under path: the position of its first id in the whole, its number of ids with the end id, and their CRC-32.

    A task for each file maps it and goes through its documents, a batch at a time. id_type: the type of the ids written.
    """

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                ids, offsets, tokens = (opened(file_name(path, r["file"], k)) for k in ("doc", "off", "bin"))
                names, at = pa.ipc.open_file(ids), 0
                for k in range(names.num_record_batches):
                    part = names.get_batch(k)
                    cuts = numbers(offsets, "<u8", at, part.num_rows + 1).astype(np.int64)
                    at += part.num_rows
                    crc = np.fromiter((checksum(tokens, r["dtype"], lo, hi) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), np.int64, part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cuts[:-1] + r["first_token"]), pa.array(np.diff(cuts)), pa.array(crc)], names=["id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.parquet(f"{path}/manifest")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(scan, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


class TokenFiles:
    """Token files under path by number of document or position, for a loader; every file is mapped when it is first read."""

    def __init__(self, path: str) -> None:
        import pyarrow.parquet as pq

        fs, root = place(path)
        self.path, self.files = path, sorted(pq.read_table(f"{root}/manifest", filesystem=fs).to_pylist(), key=lambda r: r["file"])
        self.documents, self.tokens = sum(r["documents"] for r in self.files), sum(r["tokens"] for r in self.files)
        self.source = lru_cache(maxsize=None)(lambda file, kind: opened(file_name(path, file, kind)))

    def file_of(self, n: int, base: str) -> dict:
        return self.files[bisect_right(self.files, n, key=lambda r: r[base]) - 1]

    def document(self, n: int) -> np.ndarray:
        """The ids of the n-th document (from 0), the end id among them."""
        if not 0 <= n < self.documents:
            raise IndexError(n)
        r = self.file_of(n, "first_document")
        lo, hi = numbers(self.source(r["file"], "off"), "<u8", n - r["first_document"], 2).tolist()
        return numbers(self.source(r["file"], "bin"), r["dtype"], lo, hi - lo)

    def window(self, start: int, n: int) -> np.ndarray:
        """n ids from position start on, over documents and files alike; fewer at the end."""
        out, stop = [np.empty(0, self.files[0]["dtype"] if self.files else "<u2")], min(start + n, self.tokens)
        while start < stop:
            r = self.file_of(start, "first_token")
            many = min(stop, r["first_token"] + r["tokens"]) - start
            out.append(numbers(self.source(r["file"], "bin"), r["dtype"], start - r["first_token"], many))
            start += many
        return np.concatenate(out)
