"""The signal container as a Spark data source: ``spark.read.format("signal")`` and ``df.write.format("signal")``.

Text and binary files of one data set may lie in one folder.  The schema is the fixed columns of a read, then
the auxiliary columns of all files, in the order in which the files (by name) declare them; a file without a column
gives nulls, and one name with two types is an error that names the files.  ``read_signal`` reads the headers in tasks.

Text files are cut into byte ranges at planning.  Binary ones are cut into blocks of some 64 MB by the block index
that writers leave beside them: a Parquet file whose row groups are the blocks (read_id, offset, size of each
record), with the least and the greatest id of each in its footer and a Bloom filter among its metadata.  Planning
reads footers only.  A filter on ``read_id`` (equality or IN) drops files and blocks at planning, and tasks then read the named
records alone.  Files from elsewhere may have the format's own index file (``write_index_files``), which is
streamed for places to cut; a binary file with neither is one partition.  An index table (``record_index``) turns any set of
binary records into evenly dealt ranges.

Options for reading: ``columns`` (only these are decoded), ``split_bytes``, and ``records`` = ``raw`` for undecoded records
(read_id, record), of files of one layout.  Options for writing: ``container`` (binary or text), ``record_press``,
``signal_press``, ``block_bytes``, ``attr.NAME`` for header attributes (tab-separated, one for each read group), and for raw records
``records`` = ``raw`` with ``header_of``, the container that they come from.

Writers give one file for each task, in a folder of the job that readers don't see.  The commit moves the
files that its messages name and drops the folder, so what lost attempts, twins of slow tasks and aborted
jobs have left is never read.  Appending columns whose type differs from a file's in the folder is an error.

A null signal is written as an empty one, a null read group as 0 and other null numbers as not-a-number; a null read
id is an error.  The format marks missing auxiliary values by values of their own: an empty text or list, the greatest
value of an integer type, not-a-number and the character 0 come back as null.  What a file can't hold is an error on
writing: tabs, line ends and the text ``.`` in text files, several bytes in a ``char``, numbers that no enum label has.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..schemas import RAW_RECORD, READ, READ_GROUP, RECORD_INDEX
from .codecs import RECORD_CODECS, SIGNAL_CODECS, codec_number, compress, decompress, pack_signals, unpack_signals

#: Fixed values of the format.
TEXT_FILE, BINARY_FILE = ".slow5", ".blow5"
MAGIC, END_MARK, TEXT_SIZE_AT = b"BLOW5\1", b"5WOLB", 64
TEXT_HEAD = "#slow5_version\t{}\n#num_read_groups\t{}\n"
FIXED_TYPES = "#char*\tuint32_t\tdouble\tdouble\tdouble\tdouble\tuint64_t\tint16_t*"
FIXED_NAMES = "#read_id\tread_group\tdigitisation\toffset\trange\tsampling_rate\tlen_raw_signal\traw_signal"
VERSION, NEWEST = (0, 2, 0), ((0, 2, 0), (1, 0, 0))
#: Auxiliary types: Spark's type, struct code, and the value that stands for a missing one.
AUX = {
    "int8_t": (T.ByteType(), "b", 2**7 - 1), "int16_t": (T.ShortType(), "h", 2**15 - 1), "int32_t": (T.IntegerType(), "i", 2**31 - 1), "int64_t": (T.LongType(), "q", 2**63 - 1),
    "uint8_t": (T.ShortType(), "B", 2**8 - 1), "uint16_t": (T.IntegerType(), "H", 2**16 - 1), "uint32_t": (T.LongType(), "I", 2**32 - 1), "uint64_t": (T.DecimalType(20, 0), "Q", 2**64 - 1),
    "float": (T.FloatType(), "f", float("nan")), "double": (T.DoubleType(), "d", float("nan")), "char": (T.StringType(), "c", b"\0"), "enum": (T.ShortType(), "B", 2**8 - 1),
}


@dataclass
class AuxField:
    name: str
    kind: str  # without the star
    array: bool
    labels: list[str] = field(default_factory=list)

    @property
    def spark(self) -> T.DataType:
        base = AUX[self.kind][0]
        return base if self.kind == "char" or not self.array else T.ArrayType(base)

    @property
    def declared(self) -> str:
        return (f"enum{{{','.join(self.labels)}}}" if self.kind == "enum" else self.kind) + "*" * self.array


@dataclass
class Header:
    version: tuple[int, int, int] = VERSION
    read_groups: int = 1
    attrs: dict[str, list[str]] = field(default_factory=dict)
    aux: list[AuxField] = field(default_factory=list)
    binary: bool = False
    record_codec: str = "none"
    signal_codec: str = "none"
    data_at: int = 0

    def text(self) -> str:
        lines = [f"@{k}\t" + "\t".join(v or "." for v in self.attrs[k]) for k in sorted(self.attrs)]
        lines.append("\t".join([FIXED_TYPES, *[a.declared for a in self.aux]]))
        lines.append("\t".join([FIXED_NAMES, *[a.name for a in self.aux]]))
        return "\n".join(lines) + "\n"

    def to_bytes(self) -> bytes:
        body = self.text().encode()
        if not self.binary:
            return TEXT_HEAD.format(".".join(map(str, self.version)), self.read_groups).encode() + body
        head = MAGIC + bytes([*self.version, codec_number(RECORD_CODECS, self.record_codec)]) + struct.pack("<IB", self.read_groups, codec_number(SIGNAL_CODECS, self.signal_codec))
        return head.ljust(TEXT_SIZE_AT, b"\0") + struct.pack("<I", len(body)) + body

    def schema(self) -> T.StructType:
        out = T.StructType(READ.fields[:])
        for a in self.aux:
            out = out.add(T.StructField(a.name, a.spark, True, {"kind": a.declared} | ({"labels": a.labels} if a.labels else {})))
        return out


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parse_aux(types: str, names: str) -> list[AuxField]:
    kinds, labels = types.split("\t")[8:], names.split("\t")[8:]
    if len(kinds) != len(labels) or len(set(labels)) != len(labels):
        raise ValueError("auxiliary types and names do not agree")
    out = []
    for kind, name in zip(kinds, labels, strict=True):
        array = kind.endswith("*")
        kind = kind.rstrip("*")
        enum = kind.removeprefix("enum{").removesuffix("}").split(",") if kind.startswith("enum{") else []
        if enum and not all(x.isidentifier() and x.isascii() for x in enum):
            raise ValueError(f"bad labels of {name}")
        kind = "enum" if enum else kind
        if kind not in AUX:
            raise ValueError(f"unknown type of {name}: {kind}")
        out.append(AuxField(name, kind, array, enum))
    return out


def check_version(version: tuple[int, ...]) -> tuple[int, int, int]:
    if version > NEWEST[0] and version != NEWEST[1]:
        raise ValueError(f"version {version} is newer than {NEWEST[0]}")
    return version  # type: ignore[return-value]


def read_header(stream, binary: bool) -> Header:
    h = Header(binary=binary)
    if binary:
        head = stream.read(TEXT_SIZE_AT + 4)
        if head[:6] != MAGIC:
            raise ValueError("not a binary signal container")
        h.version = check_version(tuple(head[6:9]))
        h.record_codec = RECORD_CODECS[head[9]]
        (h.read_groups,) = struct.unpack_from("<I", head, 10)
        h.signal_codec = SIGNAL_CODECS[head[14]] if h.version >= (0, 2, 0) else "none"
        (size,) = struct.unpack_from("<I", head, TEXT_SIZE_AT)
        lines = stream.read(size).decode().splitlines()
        h.data_at = len(head) + size
    else:
        data, lines = b"", []
        while not lines or not lines[-1].startswith("#read_id"):
            more = stream.read(1 << 16)
            data += more
            lines = data.decode(errors="replace").splitlines()
            at = next((i for i, s in enumerate(lines) if s.startswith("#read_id")), None)
            if at is not None and data.count(b"\n") > at:
                lines = lines[: at + 1]
                break
            if not more:
                raise ValueError("the header has no end")
        h.data_at = sum(len(s.encode()) + 1 for s in lines)
        h.version = check_version(tuple(map(int, lines[0].split("\t")[1].split("."))))
        h.read_groups = int(lines[1].split("\t")[1])
        lines = lines[2:]
    for s in lines:
        if s.startswith("@"):
            name, *values = s[1:].split("\t")
            if len(values) != h.read_groups or name in h.attrs:
                raise ValueError(f"header attribute {name}: one value for each read group is due, once")
            h.attrs[name] = ["" if v == "." else v for v in values]
    h.aux = parse_aux(lines[-2], lines[-1])
    return h


def open_header(path: str) -> Header:
    store, at = store_of(path)
    with store.open_input_stream(at, compression=None) as stream:
        return read_header(stream, path.endswith(BINARY_FILE))


def open_headers(paths: list[str]) -> list[Header]:
    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(open_header, paths))


def merged_columns(declared: Iterable[tuple[str, list[AuxField]]]) -> list[AuxField]:
    """The auxiliary columns of all files (path, columns), by first appearance."""
    found: dict[str, tuple[str, AuxField]] = {}
    for path, aux in declared:
        for a in aux:
            first, known = found.setdefault(a.name, (path, a))
            if known.declared != a.declared:
                raise ValueError(f"column {a.name} is {known.declared} in {first} and {a.declared} in {path}")
    return [a for _, a in found.values()]


def common_header(files: list[str], headers: list[Header]) -> Header:
    """The header of files whose records have one layout and one meaning."""
    first = headers[0]
    for path, h in zip(files, headers, strict=True):
        if replace(h, data_at=0, version=first.version) != replace(first, data_at=0):
            raise ValueError(f"{path} has another header than {files[0]}: its records can't be moved undecoded")
    return first


def list_files(path: str) -> list[tuple[str, int]]:
    """Containers at a path, a folder's in order of name, with their sizes."""
    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = path.rstrip("/")
        named = [(posixpath.relpath(f.path, at), f.size) for f in found if f.path.endswith((TEXT_FILE, BINARY_FILE))]
        return sorted((posixpath.join(prefix, name), size) for name, size in named if not any(part.startswith(("_", ".")) for part in name.split("/")))
    return [(path, info.size)]


def _missing(kind: str, v):
    return None if v is None or (v != v if kind in ("float", "double") else v == AUX[kind][2]) else v


def decode_text(line: str, h: Header, columns: frozenset[str] | None = None) -> tuple:
    """The row of a line; columns that aren't asked for are left null."""
    f = line.rstrip("\n").split("\t")
    if len(f) != 8 + len(h.aux):
        raise ValueError(f"a record has {len(f)} fields")
    signal = None
    if columns is None or "raw_signal" in columns:
        signal = np.array(f[7].split(","), dtype=np.int16) if f[7] not in ("", ".") else np.zeros(0, np.int16)
        if len(signal) != int(f[6]):
            raise ValueError(f"{f[0]}: the signal is not as long as it says")
    row = [f[0], int(f[1]), *map(float, f[2:6]), int(f[6]), signal]
    for a, s in zip(h.aux, f[8:], strict=True):
        if columns is not None and a.name not in columns:
            row.append(None)
            continue
        number = float if a.kind in ("float", "double") else int
        if s == ".":
            row.append(None)
        elif a.kind == "char":
            row.append(s)
        else:
            row.append([_missing(a.kind, None if x == "." else number(x)) for x in s.split(",")] if a.array else _missing(a.kind, number(s)))
    return tuple(row)


def decode_binary(data: bytes, h: Header, wanted: set[str] | None = None, columns: frozenset[str] | None = None, packed: bool = False) -> tuple | None:
    """The row of a record; None if its id isn't wanted (then nothing but the id is decoded).

    Columns that aren't asked for are stepped over and left null.  With ``packed`` a compressed signal stays as it is.
    """
    data = decompress(data, h.record_codec)
    (n,) = struct.unpack_from("<H", data)
    read_id = data[2 : 2 + n].decode()
    if wanted is not None and read_id not in wanted:
        return None
    group, *cal, size = struct.unpack_from("<IddddQ", data, 2 + n)
    at = 2 + n + 44
    skipped = columns is not None and not columns & {"raw_signal", "len_raw_signal"}
    if h.signal_codec == "none":
        signal = np.frombuffer(data, "<i2", int(size), at)
        at += 2 * size
    else:
        signal = None if skipped else data[at : at + size] if packed else np.frombuffer(decompress(data[at : at + size], h.signal_codec), "<i2")
        at += size
    row = [read_id, group, *cal, None if signal is None else len(signal), signal]
    for a in h.aux:
        code = AUX[a.kind][1]
        if columns is not None and a.name not in columns:
            width = struct.calcsize(code)
            at += 8 + width * struct.unpack_from("<Q", data, at)[0] if a.array else width
            row.append(None)
            continue
        if not a.array:
            (v,) = struct.unpack_from("<" + code, data, at)
            at += struct.calcsize(code)
            v = _missing(a.kind, v)
            row.append(v.decode() if isinstance(v, bytes) else v)
            continue
        (m,) = struct.unpack_from("<Q", data, at)
        at += 8
        width = struct.calcsize(code) * m
        if a.kind == "char":
            row.append(data[at : at + width].decode() if m else None)
        else:
            row.append([_missing(a.kind, v) for v in struct.unpack_from(f"<{m}{code}", data, at)] if m else None)
        at += width
    return tuple(row)


def number_text(x: float) -> str:
    if x != x:
        return "nan"
    s = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


def without_nulls(row: tuple) -> tuple:
    """Fixed columns that the format can hold."""
    read_id, group, *numbers, _, signal = row[:8]
    if read_id is None:
        raise ValueError("a read has no id")
    numbers = [float("nan") if x is None else x for x in numbers]
    signal = [] if signal is None else signal
    return read_id, group or 0, *numbers, len(signal), signal, *row[8:]


def checked_enum(a: AuxField, v: Iterable | int | None) -> None:
    for x in v if a.array and v is not None else [v]:
        if x is not None and not 0 <= x < len(a.labels):
            raise ValueError(f"column {a.name}: {x} is none of the {len(a.labels)} labels")


def text_field(v: str, what: str) -> str:
    if v == "." or "\t" in v or "\n" in v or "\r" in v:
        raise ValueError(f"a text container can't hold this {what}: {v[:40]!r}")
    return v


def one_char(a: AuxField, v: str) -> bytes:
    raw = v.encode()
    if len(raw) > 1:
        raise ValueError(f"column {a.name} holds single bytes, not {v[:40]!r}")
    return raw


def encode_text(row: tuple, h: Header) -> bytes:
    signal = ",".join(map(str, row[7].tolist() if isinstance(row[7], np.ndarray) else row[7]))
    out = [text_field(row[0], "read id"), str(row[1]), *map(number_text, row[2:6]), str(len(row[7])), signal]
    for a, v in zip(h.aux, row[8:], strict=True):
        if a.kind == "enum":
            checked_enum(a, v)
        if a.kind == "char" and v is not None:
            v = text_field(v if a.array else one_char(a, v).decode(), f"value of {a.name}") or None
        one = (lambda x, a=a: "." if x is None else number_text(x) if a.kind in ("float", "double") else str(x))
        out.append("." if v is None or (a.array and not len(v)) else v if a.kind == "char" else ",".join(map(one, v)) if a.array else one(v))
    return ("\t".join(out) + "\n").encode()


def encode_binary(row: tuple, h: Header, packed: bytes | None = None) -> bytes:
    """A record; ``packed``: its signal, if that is compressed already."""
    read_id = row[0].encode()
    if packed is None:
        signal = np.ascontiguousarray(row[7], dtype="<i2").tobytes()
        packed = signal if h.signal_codec == "none" else compress(signal, h.signal_codec)
    out = [struct.pack("<H", len(read_id)), read_id, struct.pack("<IddddQ", row[1], *row[2:6], len(row[7]) if h.signal_codec == "none" else len(packed)), packed]
    for a, v in zip(h.aux, row[8:], strict=True):
        _, code, missing = AUX[a.kind]
        if a.kind == "enum":
            checked_enum(a, v)
        if a.kind == "char":
            raw = (v or "").encode() if a.array else one_char(a, v or "")
            out.append(struct.pack("<Q", len(raw)) + raw if a.array else raw or missing)
        elif a.array:
            values = [missing if x is None else int(x) if code == "Q" else x for x in (v if v is not None else [])]
            out.append(struct.pack(f"<Q{len(values)}{code}", len(values), *values))
        else:
            out.append(struct.pack("<" + code, missing if v is None else int(v) if code == "Q" else v))
    data = compress(b"".join(out), h.record_codec)
    return struct.pack("<Q", len(data)) + data


def binary_records(stream, h: Header, at: int | None = None, last: bool = True) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record from the place ``at`` on; the end mark must close a file's ``last`` range."""
    at = h.data_at if at is None else at
    while True:
        head = stream.read(8)
        if head[:5] == END_MARK and len(head) == 5 or not head and not last:
            return
        if len(head) < 8:
            raise EOFError("the file is cut off: it has no end mark")
        (size,) = struct.unpack("<Q", head)
        data = stream.read(size)
        if len(data) < size:
            raise EOFError("the file is cut off inside a record")
        yield at, data
        at += 8 + size


#: Fixed values of the index file: each record's id, place and size, between two marks.
INDEX_FILE, INDEX_MAGIC, INDEX_END, INDEX_FROM = ".idx", b"SLOW5IDX\1", b"XDI5WOLS", 64


def index_entry(read_id: str, offset: int, size: int) -> bytes:
    raw = read_id.encode()
    return struct.pack("<H", len(raw)) + raw + struct.pack("<QQ", offset, size)


def record_id(data: bytes, codec: str) -> str:
    """The read id of a stored record; no more than its head is unpacked."""
    most = (1 << 16) + 2
    if codec == "zlib":
        data = zlib.decompressobj().decompress(data, most)
    elif codec == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(data) as stream:
            data = stream.read(most)
    elif codec != "none":
        data = decompress(data, codec)
    (n,) = struct.unpack_from("<H", data)
    return data[2 : 2 + n].decode()


#: The block index beside a binary container.
BLOCK_FILE, BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = ".blocks", 64 << 20, 12, 7
_BLOCK_ROWS = pa.schema([("read_id", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])


def bloom_places(ids: list[str]) -> np.ndarray:
    """Hashes of ids, a row for each, of which a filter takes remainders."""
    pairs = np.frombuffer(b"".join(hashlib.blake2b(i.encode(), digest_size=16).digest() for i in ids), "<u8").reshape(-1, 2)
    return (pairs[:, :1] >> np.uint64(1)) + np.arange(BLOOM_HASHES, dtype=np.uint64) * (pairs[:, 1:] >> np.uint64(8) | np.uint64(1))


class BlockIndexWriter:
    """Writes a block's entries when it is full; holds no more than one block's, and the filters."""

    def __init__(self, stream, block_bytes: int):
        self.writer, self.block_bytes = pq.ParquetWriter(stream, _BLOCK_ROWS, compression="zstd"), block_bytes
        self.entries: list[tuple[str, int, int]] = []
        self.held = 0
        self.blooms: list[str] = []

    def add(self, read_id: str, offset: int, size: int) -> None:
        if self.entries and self.held + size > self.block_bytes:
            self.close_block()
        self.entries.append((read_id, offset, size))
        self.held += size

    def close_block(self) -> None:
        rows = pa.table([pa.array(c, f.type) for c, f in zip(zip(*self.entries, strict=True), _BLOCK_ROWS, strict=True)], schema=_BLOCK_ROWS)
        self.writer.write_table(rows, row_group_size=len(rows))
        bits = np.zeros(-(-len(rows) * BLOOM_BITS // 8) * 8, bool)
        bits[(bloom_places([e[0] for e in self.entries]) % np.uint64(len(bits))).ravel()] = True
        self.blooms.append(base64.b64encode(np.packbits(bits).tobytes()).decode())
        self.entries, self.held = [], 0

    def close(self) -> None:
        if self.entries:
            self.close_block()
        self.writer.add_key_value_metadata({"blooms": " ".join(self.blooms)})
        self.writer.close()


@dataclass
class Block:
    number: int
    offset: int
    least: str
    greatest: str
    bloom: str

    def may_hold(self, ids: list[str], places: np.ndarray) -> bool:
        near = np.array([self.least <= i <= self.greatest for i in ids], bool)
        if not near.any():
            return False
        bits = np.unpackbits(np.frombuffer(base64.b64decode(self.bloom), np.uint8)).astype(bool)
        return bool(bits[(places[near] % np.uint64(len(bits))).astype(np.int64)].all(axis=1).any())


def read_blocks(path: str) -> list[Block] | None:
    """The blocks of a container, from the footer of its block index; None without one."""
    store, at = store_of(path + BLOCK_FILE)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_file(at) as f:
        m = pq.read_metadata(f)
    blooms = m.metadata[b"blooms"].decode().split()
    stats = [[m.row_group(g).column(c).statistics for c in (0, 1)] for g in range(m.num_row_groups)]
    named = lambda x: (x.min, x.max) if x is not None and x.has_min_max else ("", chr(0x10FFFF))  # noqa: E731  none for very long ids
    return [Block(g, places.min, *named(ids), blooms[g]) for g, (ids, places) in enumerate(stats)]


def read_index_file(path: str) -> list[tuple[str, int, int]] | None:
    """(read_id, offset, size) of each record of a container, in the order of the file; None without an index file."""
    store, at = store_of(path + INDEX_FILE)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at, compression=None) as stream:
        data = stream.read()
    if data[: len(INDEX_MAGIC)] != INDEX_MAGIC or not data.endswith(INDEX_END):
        raise ValueError(f"{path}{INDEX_FILE} is no index, or is cut off")
    out, place = [], INDEX_FROM
    while place < len(data) - len(INDEX_END):
        (n,) = struct.unpack_from("<H", data, place)
        out.append((data[place + 2 : place + 2 + n].decode(), *struct.unpack_from("<QQ", data, place + 2 + n)))
        place += 18 + n
    return sorted(out, key=lambda r: r[1])


def index_cuts(path: str, split: int) -> list[int]:
    """Places of records some ``split`` bytes apart, by the format's own index file; one number for each range is held."""
    store, at = store_of(path + INDEX_FILE)
    if store.get_file_info(at).type != fs.FileType.File:
        return []
    cuts: dict[int, int] = {}
    with store.open_input_stream(at, compression=None, buffer_size=1 << 20) as stream:
        if stream.read(INDEX_FROM)[: len(INDEX_MAGIC)] != INDEX_MAGIC:
            raise ValueError(f"{path}{INDEX_FILE} is no index, or is cut off")
        while True:
            head = stream.read(2)
            if head == INDEX_END[:2]:
                rest = stream.read(len(INDEX_END) - 2)
                if rest == INDEX_END[2:]:
                    break
                head, left = head, rest
            else:
                left = b""
            if len(head) < 2:
                raise ValueError(f"{path}{INDEX_FILE} is no index, or is cut off")
            (n,) = struct.unpack("<H", head)
            entry = left + stream.read(n + 16 - len(left))
            if len(entry) < n + 16:
                raise ValueError(f"{path}{INDEX_FILE} is no index, or is cut off")
            (offset,) = struct.unpack_from("<Q", entry, n)
            cuts[offset // split] = min(offset, cuts.get(offset // split, offset))
    return sorted(cuts.values())


def binary_ranges(path: str, size: int, split: int) -> list[tuple[int, int]]:
    """Byte ranges of about ``split`` bytes that begin at records, as far as an index says where those are."""
    cuts = [0]
    blocks = read_blocks(path)
    if blocks is None or split < BLOCK_BYTES:
        cuts += index_cuts(path, split)[1:]
    if len(cuts) == 1 and blocks is not None:
        reached = split
        for b in blocks[1:]:
            if b.offset >= reached:
                cuts.append(b.offset)
                reached = b.offset + split
    return list(zip(cuts, [*cuts[1:], size], strict=True))


@dataclass
class Range(InputPartition):
    """Bytes of a file; with ``blocks`` only the wanted records that the index's blocks of these numbers name."""

    path: str
    start: int
    end: int
    blocks: list[int] | None = None


#: Ranges that a scan is cut into, about: where ``split_bytes`` would give more, ranges are longer, as a task for a few records is mostly overhead.
MOST_RANGES = 2048


class SignalReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", BLOCK_BYTES))
        self.raw = options.get("records") == "raw"
        self.schema = schema
        self.names = schema.names
        self.columns = frozenset(schema.names)
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("read_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = ids if self.wanted is None else self.wanted & ids
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        ids = sorted(i for i in self.wanted if i is not None) if self.wanted is not None else None
        places = bloom_places(ids) if ids else None
        files = list(list_files(self.path))
        split = max(self.split, -(-sum(size for _, size in files) // MOST_RANGES))
        for path, size in files:
            if not path.endswith(BINARY_FILE):
                out += [Range(path, at, min(size, at + split)) for at in range(0, size, split)]
                continue
            blocks = read_blocks(path) if ids is not None else None
            if blocks is None:
                out += [Range(path, *r) for r in binary_ranges(path, size, split)]
            elif ids and (found := [b.number for b in blocks if b.may_hold(ids, places)]):
                out.append(Range(path, 0, size, found))
        return out

    def records(self, part: Range) -> Iterator[tuple[Header, bytes]]:
        """Stored records of a range and the header that says how to read them."""
        store, at = store_of(part.path)
        if part.path.endswith(BINARY_FILE):
            with store.open_input_stream(at, compression=None, buffer_size=1 << 20) as stream:
                h = read_header(stream, True)
            if part.blocks is not None:
                index_store, index_at = store_of(part.path + BLOCK_FILE)
                with store.open_input_file(at) as file, index_store.open_input_file(index_at) as f:
                    index = pq.ParquetFile(f)
                    for block in part.blocks:
                        rows = index.read_row_group(block)
                        for read_id, offset, size in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                            if read_id in self.wanted:
                                yield h, file.read_at(size, offset)[8:]
                return
            with store.open_input_file(at) as file:
                begin, last = max(part.start, h.data_at), part.end >= file.size()
                whole = file.get_stream(begin, (file.size() if last else part.end) - begin)
                with pa.BufferedInputStream(whole, 1 << 20) as stream:
                    for _, data in binary_records(stream, h, begin, last):
                        yield h, data
            return
        with store.open_input_file(at) as file:
            h = read_header(file, False)
            begin = max(part.start, h.data_at)
            # A range owns the lines that begin in it.
            file.seek(begin - 1 if begin > h.data_at else begin)
            held, place = b"", file.tell()
            skip = begin > h.data_at
            while True:
                cut = held.find(b"\n")
                while cut < 0:
                    more = file.read(1 << 20)
                    if not more:
                        break
                    cut = len(held) + more.find(b"\n") if b"\n" in more else -1
                    held += more
                if cut < 0:
                    cut = len(held)
                    if not held:
                        return
                line, held, line_at = held[:cut], held[cut + 1 :], place
                place += cut + 1
                if skip:
                    skip = False
                    continue
                if line_at >= part.end:
                    return
                if line:
                    yield h, line

    def rows(self, part: Range) -> Iterator[tuple]:
        places, binary = None, part.path.endswith(BINARY_FILE)
        waiting, held = [], 0
        for h, data in self.records(part):
            if self.raw:
                read_id = None
                if self.wanted is not None or "read_id" in self.columns:
                    read_id = record_id(data, h.record_codec) if binary else data.split(b"\t", 1)[0].decode()
                if self.wanted is None or read_id in self.wanted:
                    yield tuple({"read_id": read_id, "record": data}[n] for n in self.names)
                continue
            if places is None:
                have = {n: i for i, n in enumerate([*READ.names, *[a.name for a in h.aux]])}
                places = [have.get(n, -1) for n in self.names]
            if binary:
                row = decode_binary(data, h, self.wanted, self.columns, h.signal_codec == "svb-zd")
            else:
                row = decode_text(data.decode(), h, self.columns) if self.wanted is None or data.split(b"\t", 1)[0].decode() in self.wanted else None
            if row is None:
                continue
            if binary and isinstance(row[7], bytes):
                waiting.append(row)
                held += len(row[7])
                if held > 1 << 20 or len(waiting) == 4096:
                    yield from unpacked(waiting, places)
                    waiting, held = [], 0
                continue
            yield tuple(row[p] if p >= 0 else None for p in places)
        yield from unpacked(waiting, places)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        large = {"raw_signal", "record"} & self.columns
        large = self.names.index(large.pop()) if large else None
        rows: list[tuple] = []
        held = 0
        for row in self.rows(partition):
            rows.append(row)
            held += 2 * len(row[large]) if large is not None else 64
            if held > 8 << 20 or len(rows) >= 10_000:
                yield rows_batch(rows, kind)
                rows, held = [], 0
        if rows:
            yield rows_batch(rows, kind)


def unpacked(rows: list[tuple], places: list[int] | None) -> Iterator[tuple]:
    """Rows with packed signals, which are unpacked together."""
    for row, signal in zip(rows, unpack_signals([r[7] for r in rows]), strict=True):
        full = (*row[:6], len(signal), signal, *row[8:])
        yield tuple(full[p] if p >= 0 else None for p in places)


def rows_batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    """Signals are joined as arrays, so no sample becomes a Python number."""

    def column(c: tuple, t: pa.DataType) -> pa.Array:
        if not pa.types.is_list(t) or not all(isinstance(x, np.ndarray) for x in c):
            return pa.array(c, t)
        ends = np.cumsum([0, *map(len, c)])
        if ends[-1] > np.iinfo(np.int32).max:
            return pa.array(c, t)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(c), t.value_type), type=t)

    return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def signal_slices(column: pa.Array) -> list[np.ndarray | None]:
    """Each list of a column as a view of its values."""
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True)]


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class SignalWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.raw = options.get("records") == "raw"
        self.block_bytes = int(options.get("block_bytes", BLOCK_BYTES))
        self.names = schema.names
        self.job = f"_signal-{uuid.uuid4().hex}"  # made on the driver, the same for all tasks
        attrs = {k.removeprefix("attr."): v.split("\t") for k, v in options.items() if k.startswith("attr.")}
        if self.raw:
            self._raw_header(options, attrs)
        else:
            self._header(options, schema, attrs)
        if any("\n" in v or "\r" in v for values in self.header.attrs.values() for v in values):
            raise ValueError("a header attribute has a line end")
        if not overwrite:
            old = [p for p, _ in list_files(self.path)] if self._folder_exists() else []
            merged_columns([*((p, h.aux) for p, h in zip(old, open_headers(old), strict=True)), ("the rows to be appended", self.header.aux)])

    def _folder_exists(self) -> bool:
        store, at = store_of(self.path)
        return store.get_file_info(at).type == fs.FileType.Directory

    def _header(self, options: dict, schema: T.StructType, attrs: dict[str, list[str]]) -> None:
        self.binary = options.get("container", "binary") == "binary"
        aux = []
        kinds = {s.simpleString(): k for k, (s, _, _) in reversed(AUX.items()) if k not in ("enum", "uint8_t", "uint16_t", "uint32_t")}
        for f in schema.fields[len(READ.fields) :]:
            declared = (f.metadata or {}).get("kind")
            simple = f.dataType.simpleString()
            if declared:
                aux += parse_aux("\t" * 8 + declared, "\t" * 8 + f.name)
            elif simple == "string":
                aux.append(AuxField(f.name, "char", True))
            else:
                array = simple.startswith("array<")
                aux.append(AuxField(f.name, kinds[simple.removeprefix("array<").removesuffix(">")], array))
        groups = max([1, *map(len, attrs.values())])
        attrs = {k: [*v, *[""] * (groups - len(v))] for k, v in attrs.items()}
        self.header = Header(VERSION, groups, attrs, aux, self.binary, options.get("record_press", "zlib") if self.binary else "none", options.get("signal_press", "svb-zd") if self.binary else "none")
        if self.names[: len(READ.names)] != READ.names:
            raise ValueError(f"the first columns must be {READ.names}")

    def _raw_header(self, options: dict, attrs: dict[str, list[str]]) -> None:
        files = [p for p, _ in list_files(options["header_of"])]
        h = common_header(files, open_headers(files))
        self.binary, self.stored_codec = h.binary, h.record_codec
        if "record" not in self.names:
            raise ValueError("raw records have a column named record")
        merged = h.attrs | attrs
        groups = max([h.read_groups, *map(len, merged.values())])
        merged = {k: [*v, *[""] * (groups - len(v))] for k, v in merged.items()}
        self.header = replace(h, version=VERSION, attrs=merged, read_groups=groups, record_codec=options.get("record_press", h.record_codec) if h.binary else "none")

    def encoded(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        """(read_id, stored bytes) of each row."""
        if self.raw:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(self.names)}
            for i, data in enumerate(columns["record"]):
                read_id = columns["read_id"][i] if "read_id" in columns else record_id(data, self.stored_codec) if self.binary else ""
                if not self.binary:
                    yield read_id, data + b"\n"
                    continue
                if self.header.record_codec != self.stored_codec:
                    data = compress(decompress(data, self.stored_codec), self.header.record_codec)
                yield read_id, struct.pack("<Q", len(data)) + data
            return
        signal = READ.names.index("raw_signal")
        columns = [signal_slices(c) if i == signal else c.to_pylist() for i, c in enumerate(batch.columns)]
        if self.binary and self.header.signal_codec == "svb-zd":
            for at in range(0, batch.num_rows, 4096):
                rows = [without_nulls(r) for r in zip(*(c[at : at + 4096] for c in columns), strict=True)]
                for row, packed in zip(rows, pack_signals([np.asarray(r[7], np.int16) for r in rows]), strict=True):
                    yield row[0], encode_binary(row, self.header, packed)
            return
        encode = encode_binary if self.binary else encode_text
        for row in map(without_nulls, zip(*columns, strict=True)):
            yield row[0], encode(row, self.header)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = store_of(self.path)
        folder = posixpath.join(at, self.job)
        store.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}{BINARY_FILE if self.binary else TEXT_FILE}"
        n = 0
        with store.open_output_stream(posixpath.join(folder, name), compression=None) as out:
            head = self.header.to_bytes()
            out.write(head)
            place = len(head)
            if not self.binary:
                for batch in iterator:
                    for _, data in self.encoded(batch):
                        out.write(data)
                        n += 1
                return Written(name, n)
            with store.open_output_stream(posixpath.join(folder, name + BLOCK_FILE), compression=None) as index_out:
                index = BlockIndexWriter(index_out, self.block_bytes)
                try:
                    for batch in iterator:
                        for read_id, data in self.encoded(batch):
                            out.write(data)
                            index.add(read_id, place, len(data))
                            place += len(data)
                            n += 1
                    index.close()
                finally:
                    index.writer.close()
            out.write(END_MARK)
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        kept = {m.path for m in messages if m}
        if self.overwrite and self._folder_exists():
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.base_name.removesuffix(INDEX_FILE).removesuffix(BLOCK_FILE).endswith((TEXT_FILE, BINARY_FILE)):
                    store.delete_file(f.path)
        for name in sorted(kept):
            for part in (name + BLOCK_FILE, name) if self.binary else (name,):  # an index never lacks beside its file
                store.move(posixpath.join(at, self.job, part), posixpath.join(at, part))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Drop the job's folder with all that is left in it."""
        store, at = store_of(self.path)
        folder = posixpath.join(at, self.job)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class SignalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signal"

    def schema(self) -> T.StructType:
        files = [p for p, _ in list_files(self.options["path"])]
        if not files:
            raise ValueError(f"no containers at {self.options['path']}")
        headers = open_headers(files)
        if self.options.get("records") == "raw":
            common_header(files, headers)
            full = RAW_RECORD
        else:
            full = Header(aux=merged_columns((p, h.aux) for p, h in zip(files, headers, strict=True))).schema()
        if "columns" not in self.options:
            return full
        return T.StructType([full[c.strip()] for c in self.options["columns"].split(",")])

    def reader(self, schema: T.StructType) -> SignalReader:
        return SignalReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SignalWriter:
        return SignalWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SignalSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_signal(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The containers at a path; their headers are read in tasks, and only different sets of columns come to the driver."""
    register(spark)
    files = spark.createDataFrame([(p,) for p, _ in list_files(path)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            lines = [(p, "\t".join(a.declared for a in h.aux), "\t".join(a.name for a in h.aux)) for p, h in zip(paths, open_headers(paths), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*lines, strict=True)], ["path", "kinds", "names"])

    layouts = files.mapInArrow(run, "path string, kinds string, names string").groupBy("kinds", "names").agg(F.min("path").alias("path")).orderBy("path").collect()
    declared = ((r["path"], parse_aux("\t" * 8 + r["kinds"], "\t" * 8 + r["names"]) if r["names"] else []) for r in layouts)
    return spark.read.format("signal").schema(Header(aux=merged_columns(declared)).schema()).options(**options).load(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Header attributes: path, read_group, attrs.  The headers of the files are read in tasks."""
    files = spark.createDataFrame([(p,) for p, _ in list_files(path)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, g, {k: v[g] for k, v in h.attrs.items()}) for p in batch.column(0).to_pylist() for h in [open_header(p)] for g in range(h.read_groups)]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())), strict=True)], READ_GROUP.names)

    return files.mapInArrow(run, READ_GROUP)


def entries_of(path: str) -> Iterator[list[tuple[str, int, int]]]:
    """(read_id, offset, size) of each record of a binary container, in parts: from its block index, else by walking its records."""
    store, at = store_of(path)
    index_store, index_at = store_of(path + BLOCK_FILE)
    if index_store.get_file_info(index_at).type == fs.FileType.File:
        with index_store.open_input_file(index_at) as f:
            index = pq.ParquetFile(f)
            for g in range(index.num_row_groups):
                yield list(zip(*(c.to_pylist() for c in index.read_row_group(g).columns), strict=True))
        return
    with store.open_input_stream(at, compression=None, buffer_size=1 << 20) as stream:
        h = read_header(stream, True)
        rows = []
        for offset, data in binary_records(stream, h):
            rows.append((record_id(data, h.record_codec), offset, 8 + len(data)))
            if len(rows) == 10_000:
                yield rows
                rows = []
        if rows:
            yield rows


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record of the binary containers at ``path`` lies; keep it as a table beside them."""
    files = spark.createDataFrame([(p,) for p, _ in list_files(path) if p.endswith(BINARY_FILE)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for rows in entries_of(p):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([p] * len(rows), *zip(*rows, strict=True))], RECORD_INDEX.names)

    return files.repartition(max(1, len(list_files(path)))).mapInArrow(run, RECORD_INDEX)


def fetch(index: DataFrame, schema: T.StructType) -> DataFrame:
    """The records that rows of an index name; filter or join the index first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file, places, h = None, None, [], None
        try:
            for batch in batches:
                rows = []
                for path, offset, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if path != opened:  # rows are in the order of files
                        if file is not None:
                            file.close()
                        store, at = store_of(path)
                        opened, file, h = path, store.open_input_file(at), open_header(path)
                        have = {n: i for i, n in enumerate([*READ.names, *[a.name for a in h.aux]])}
                        places = [have.get(n, -1) for n in schema.names]
                    row = decode_binary(file.read_at(size, offset)[8:], h, None, frozenset(schema.names))
                    rows.append(tuple(row[p] if p >= 0 else None for p in places))
                if rows:
                    yield rows_batch(rows, kind)
        finally:
            if file is not None:
                file.close()

    return index.sort("path", "offset").select("path", "offset", "size").mapInArrow(run, schema)


def write_index_files(spark: SparkSession, path: str) -> DataFrame:
    """Write the format's own index file beside each binary container; (path, records), one row for each.

    Entries are written as they are met, so a task holds some thousands of them.
    """
    files = spark.createDataFrame([(p,) for p, _ in list_files(path) if p.endswith(BINARY_FILE)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for p in batch.column(0).to_pylist():
                store, at = store_of(p)
                hidden, n = posixpath.join(posixpath.dirname(at), f"_{uuid.uuid4().hex}{INDEX_FILE}"), 0
                with store.open_output_stream(hidden, compression=None) as out:
                    out.write((INDEX_MAGIC + bytes(open_header(p).version)).ljust(INDEX_FROM, b"\0"))
                    for rows in entries_of(p):
                        out.write(b"".join(index_entry(*r) for r in rows))
                        n += len(rows)
                    out.write(INDEX_END)
                store.move(hidden, at + INDEX_FILE)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["path", "records"])

    return files.repartition(max(1, len(list_files(path)))).mapInArrow(run, "path string, records long")


def copy_records(spark: SparkSession, source: str, out: str, ids: DataFrame | None = None, files: int | None = None, record_press: str | None = None, **attrs: str) -> None:
    """Containers of one layout copied record by record, undecoded.

    ``ids`` (read_id): only these; ``files``: dealt anew to so many; ``record_press``: another codec of
    the records, whose signals stay as they are; ``attrs``: header attributes that are set or replaced, tab-separated by read
    group.  More values than there were read groups add some.
    """
    register(spark)
    rows = spark.read.format("signal").option("records", "raw").load(source)
    if ids is not None:
        rows = rows.join(ids.select("read_id"), "read_id", "left_semi").select(*RAW_RECORD.names)
    if files is not None:
        rows = rows.repartition(files)
    options = {"records": "raw", "header_of": source} | ({"record_press": record_press} if record_press else {}) | {f"attr.{k}": v for k, v in attrs.items()}
    rows.write.format("signal").mode("append").options(**options).save(out)


def duplicate_ids(index: DataFrame) -> DataFrame:
    """Read ids that occur more than once, which an index must not hold."""
    return index.groupBy("read_id").agg(F.count("*").alias("n")).filter("n > 1")
