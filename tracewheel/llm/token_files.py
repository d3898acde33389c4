"""Token-ID files: ids in fixed-size blocks, transposed into planes, each plane compressed.

File layout (all integers little-endian)::

    b"TWPLANE1"                          magic
    block*                               the compressed planes of one block, one after another
    index                                zstandard frame of the chunk index
    u64 index_offset, u64 index_size, b"TWPLANE1"

The chunk index holds: u32 plane kind (0 byte, 1 bit), u32 block size, u64 number of blocks,
u64 number of documents; for each block u64 offset, u32 number of ids and u32 plane sizes;
for each document i64 doc_id, u8 null flag and u64 number of ids. A block is found and
decoded without reading any other.

A byte plane k has byte k of every id of the block; a bit plane k has bit k of every id,
packed eight to a byte. High planes of small vocabularies are all zero and cost a few bytes.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.llm.common import fresh_path, only, stage, text_key

MAGIC = b"TWPLANE1"
KINDS = ("byte", "bit")
PLANES = {"byte": 4, "bit": 32}
BLOCK_IDS = 65536
END_ID = 2


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes documents' ids to a binary stream; memory is bounded by one block and the index."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        import zstandard

        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.pending_ids = 0
        self.blocks: list[bytes] = []
        self.docs = bytearray()
        self.n_docs = self.n_ids = 0
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian u32."""
        n = len(ids) // 4
        self.docs += struct.pack("<qBQ", doc_id or 0, doc_id is None, n)
        self.n_docs += 1
        self.n_ids += n
        self.pending.append(ids)
        self.pending_ids += n
        if self.pending_ids >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        full = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for start in range(0, full, self.block_ids):
            block = ids[start : min(full, start + self.block_ids)]
            packed = [self.packer.compress(p) for p in to_planes(block, self.kind)]
            self.blocks.append(struct.pack(f"<QI{len(packed)}I", self.at, len(block), *map(len, packed)))
            for p in packed:
                self.out.write(p)
                self.at += len(p)
        rest = ids[full:].tobytes()
        self.pending, self.pending_ids = [rest] if rest else [], len(rest) // 4

    def close(self) -> None:
        self._flush(True)
        head = struct.pack("<IIQQ", KINDS.index(self.kind), self.block_ids, len(self.blocks), self.n_docs)
        index = self.packer.compress(head + b"".join(self.blocks) + bytes(self.docs))
        self.out.write(index)
        self.out.write(struct.pack("<QQ", self.at, len(index)) + MAGIC)


class PlaneReader:
    """Random access to the blocks of a file through its chunk index."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        file.seek(0, io.SEEK_END)
        size = file.tell()
        tail = self._read(size - 24, 24)
        if tail[16:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a plane file, or one cut short")
        at, n = struct.unpack("<QQ", tail[:16])
        index = self.unpacker.decompress(self._read(at, n))
        kind, self.block_ids, n_blocks, n_docs = struct.unpack_from("<IIQQ", index)
        self.kind = KINDS[kind]
        width = 12 + 4 * PLANES[self.kind]
        names = [("at", "<u8"), ("n", "<u4"), ("sizes", "<u4", (PLANES[self.kind],))]
        self.blocks = np.frombuffer(index, np.dtype(names), n_blocks, 24)
        self.docs = np.frombuffer(index, np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")]), n_docs, 24 + width * n_blocks)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        b = self.blocks[k]
        raw = self._read(int(b["at"]), int(b["sizes"].sum()))
        ends = np.cumsum(b["sizes"])
        planes = [self.unpacker.decompress(raw[int(e - s) : int(e)]) for s, e in zip(b["sizes"], ends, strict=True)]
        return from_planes(planes, int(b["n"]), self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, number of ids, crc32 of the ids) of each document; one block in memory at a time."""
        k, block, used = 0, b"", 0
        for doc_id, null, n in self.docs.tolist():
            left, crc = 4 * n, 0
            while left:
                if used == len(block):
                    block, k, used = self.block(k).astype("<u4").tobytes(), k + 1, 0
                take = min(left, len(block) - used)
                crc = zlib.crc32(block[used : used + take], crc)
                used += take
                left -= take
            yield None if null else doc_id, n, crc


_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


class PieceEncoder:
    """Byte-level BPE of whole texts, each distinct piece encoded once.

    In a byte-level pre-tokenizer a blank before a non-blank always starts a new piece, and a
    line end after and before non-blanks is a piece of its own, so a text in which white space
    is only ever one blank or one line end can be cut there: its ids are those of its pieces in
    order. Any other text is encoded as it stands. Two generations of at most ``keep`` pieces
    each bound the memory; a piece that has been dropped is encoded anew. A text that holds
    the string of an added token is encoded as it stands: there that string is its token's id,
    or ordinary text with ``plain_specials``.
    """

    def __init__(self, path: str, keep: int = 350_000, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.keep = self.tokenizer.model, keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.stems_old: dict[str, bytes] = {}
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.shown = {c: "".join(x[0] for x in split(c)) for c in map(chr, range(0x21, 0x100)) if _LATIN.fullmatch(c)}
        self.table = str.maketrans(self.shown)
        self.blank = split(" a")[0][0][0]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, shown: str) -> bytes:
        got = self.stems.get(shown)
        if got is None:
            got = self.stems_old.get(shown)
            if got is None:
                got = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.stems[shown] = got
            if len(self.stems) >= self.keep:
                self.stems_old, self.stems = self.stems, {}
        return got

    def _piece(self, piece: str) -> bytes:
        """``piece`` follows a blank unless it starts with a line end or with a mark for the text's start."""
        start = piece[:1] == "\r"
        line = piece[:1] == "\n"
        body = piece[1:] if start or line else piece
        m = _LATIN.match(body)
        if m and m.end() >= len(body) - 1 and (m.end() == len(body) or body[-1] in ".,"):
            word, mark = body[: m.end()], body[m.end() :]
            out = self._stem(word.translate(self.table) if start or line else self.blank + word.translate(self.table))
            if line:
                out = self.whole("\n") + out
            return out + self._stem(mark) if mark else out
        return self.whole(body if start else piece if line else " " + piece)

    def texts(self, texts: list[str]) -> list[bytes]:
        cache, out = self.young, []
        for text in texts:
            flat = text.replace("\n", " ")
            if not flat.isprintable() or "  " in flat or flat[:1] == " " or flat[-1:] == " " or any(a in text for a in self.added):
                out.append(self.whole(text))
                continue
            pieces = ("\r" + text.replace("\n", " \n")).split(" ") if text else []
            ids = list(map(cache.get, pieces))
            if None in ids:
                for i, got in enumerate(ids):
                    if got is None:
                        p = pieces[i]
                        got = cache.get(p) or self.old.get(p)
                        ids[i] = cache[p] = self._piece(p) if got is None else got
            out.append(b"".join(ids))
        if len(cache) >= self.keep:
            self.old, self.young = cache, {}
        return out


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, plain_specials: bool = False) -> PieceEncoder:
    """One encoder a Python worker, kept between tasks."""
    if (path, plain_specials) not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path, plain_specials] = PieceEncoder(path, plain_specials=plain_specials)
    return _ENCODERS[path, plain_specials]


def open_place(uri: str):
    """File system and path of a URI or an absolute local path, in any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Texts are encoded in groups of about this many characters.
GROUP_CHARS = 1 << 21


def _groups(texts: Iterable[tuple[int | None, str]]) -> Iterator[list[tuple[int | None, str]]]:
    group, size = [], 0
    for row in texts:
        group.append(row)
        size += len(row[1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, kind: str = "byte", block_ids: int = BLOCK_IDS, plain_specials: bool = False) -> DataFrame:
    """Encodes every text and writes one plane file a partition, in ascending doc_id order.

    Returns the manifest (part, file, n_docs, n_ids), kept as a table: only files named in it
    count, so what a lost or repeated task has written is never read. Null doc_ids come first,
    a null text is empty, equal doc_ids are ordered by the hash of their text, so that very many
    rows without an id are dealt over partitions too; an empty table gives an empty manifest. Columns other than doc_id and text are ignored. The string of an added token is
    that token, or ordinary text with ``plain_specials``.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, tail = encoder(tokenizer_path, plain_specials), struct.pack("<I", end_id)
        fs, root = open_place(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.twp"
        writer, out = None, None
        rows = ((d, t or "") for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for group in _groups(rows):
            if writer is None:
                out = fs.open_output_stream(f"{root}/{name}")
                writer = PlaneWriter(out, kind, block_ids)
            for (doc_id, _), ids in zip(group, enc.texts([t for _, t in group]), strict=True):
                writer.add(doc_id, ids + tail)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([writer.n_docs], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    rows = only(docs, doc_id="long", text="string").withColumn("h", text_key(F.col("text")))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return stage(rows.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches):
        fs, root = open_place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as f:
                    at, cols = row["base"], ([], [], [], [])
                    for doc_id, n, crc in PlaneReader(f).documents():
                        for c, v in zip(cols, (doc_id, at, n, crc), strict=True):
                            c.append(v)
                        at += n
                        if len(cols[0]) >= 8192:
                            yield _batch(cols)
                            cols = ([], [], [], [])
                    yield _batch(cols)

    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_binary(docs: DataFrame, tokenizer_path: str | None = None, kind: str = "byte") -> DataFrame:
    """Writes ``docs`` as token files under the shared folder and returns what the files hold."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, folder, kind=kind), folder)


def query(spark, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold; edge cases are those of ``write_token_files``."""
    return token_binary(spark.read.parquet(f"{sf_dir}/documents.parquet"))
