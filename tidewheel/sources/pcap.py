"""TCP payloads of packet captures, as a Python data source: spark.read.format("tcp_pcap").load(path).

Reads captures with microsecond or nanosecond times in either byte order, and the next-generation block
format; Ethernet with or without VLAN tags, raw IP, loopback and Linux cooked links; IPv4.  A row is a
packet with a payload, cut to the length that its IP header gives, which leaves link padding out.  Paths may be of any
file system that Arrow opens.  A file is read as a stream; a classic one of more than SPLIT bytes is several
tasks: the driver walks its record headers once to find where packets begin.  Next-generation files are one
task each.  A file that ends within a packet ends there.
"""

from __future__ import annotations

import fnmatch
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, seq long, src_ip string, src_port int, dst_ip string, dst_port int, ts double, payload binary"
_MAGIC = {0xA1B2C3D4: 1e6, 0xA1B23C4D: 1e9}
_NEXT_GENERATION = 0x0A0D0D0A
#: Bytes of a classic capture that a task reads.
SPLIT = 128 << 20
ETHERNET, RAW, RAW_OLD, NULL_LINK, COOKED = 1, 101, 12, 0, 113


def file_system(path: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{os.path.abspath(path)}")


def _order(head: bytes) -> tuple[str, float]:
    order = "<" if struct.unpack("<I", head)[0] in _MAGIC else ">"
    return order, _MAGIC[struct.unpack(order + "I", head)[0]]


def _classic(f: BinaryIO, head: bytes) -> Iterator[tuple[int, float, bytes]]:
    order, scale = _order(head)
    rest = f.read(20)
    if len(rest) < 20:
        return
    yield from _records(f, order, scale, struct.unpack(order + "I", rest[16:])[0] & 0xFFFF)


def _records(f: BinaryIO, order: str, scale: float, link: int) -> Iterator[tuple[int, float, bytes]]:
    while len(record := f.read(16)) == 16:
        seconds, part, size, _ = struct.unpack(order + "IIII", record)
        data = f.read(size)
        if len(data) < size:
            return
        yield link, seconds + part / scale, data


def capture_header() -> bytes:
    """Of a classic capture of Ethernet packets."""
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, ETHERNET)


def capture_record(src: str, sport: int, dst: str, dport: int, payload: bytes | None, seconds: int = 0) -> bytes:
    """A TCP packet as a record of a classic capture; checksums are left at 0."""
    tcp_ = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 24, 8192, 0, 0) + (payload or b"")[: 65535 - 40]
    addresses = b"".join(bytes(map(int, a.split("."))) for a in (src, dst))
    packet = b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp_), 0, 0, 64, 6, 0) + addresses + tcp_
    return struct.pack("<IIII", seconds, 0, len(packet), len(packet)) + packet


def _blocks(f: BinaryIO, head: bytes) -> Iterator[tuple[int, float, bytes]]:
    order, links = "<", []
    start = head + f.read(4)
    while len(start) == 8:
        if struct.unpack("<I", start[:4])[0] == _NEXT_GENERATION:
            magic = f.read(4)
            order, links = ("<" if magic == b"\x4d\x3c\x2b\x1a" else ">"), []
            kind, size = _NEXT_GENERATION, struct.unpack(order + "I", start[4:])[0]
            f.read(max(0, size - 12))
        else:
            kind, size = struct.unpack(order + "II", start)
            body = f.read(max(0, size - 8))
            if len(body) < size - 8:
                return
            if kind == 1:
                links.append((struct.unpack(order + "H", body[:2])[0], _resolution(body[8:-4], order)))
            elif kind == 6:
                n, high, low, got = struct.unpack(order + "IIII", body[:16])
                if n < len(links):
                    yield links[n][0], ((high << 32) + low) / links[n][1], body[20 : 20 + got]
        start = f.read(8)


def _resolution(options: bytes, order: str) -> float:
    while len(options) >= 4:
        code, size = struct.unpack(order + "HH", options[:4])
        if code == 0:
            break
        if code == 9 and size:
            v = options[4]
            return float(2 ** (v & 0x7F)) if v & 0x80 else 10.0**v
        options = options[4 + (size + 3) // 4 * 4 :]
    return 1e6


def _ip(link: int, data: bytes) -> bytes:
    """What follows the link's header, if that is IPv4; else nothing."""
    if link == ETHERNET:
        at, kind = 14, data[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = data[at + 2 : at + 4], at + 4
        return data[at:] if kind == b"\x08\x00" else b""
    if link == COOKED:
        return data[16:] if data[14:16] == b"\x08\x00" else b""
    if link == NULL_LINK:
        return data[4:]
    return data if link in (RAW, RAW_OLD) else b""


def tcp(link: int, data: bytes) -> tuple[str, int, str, int, bytes] | None:
    """Addresses, ports and payload of a TCP packet that has one."""
    ip = _ip(link, data)
    if len(ip) < 20 or ip[0] >> 4 != 4 or ip[9] != 6 or struct.unpack(">H", ip[6:8])[0] & 0x1FFF:
        return None
    begin, total = (ip[0] & 15) * 4, struct.unpack(">H", ip[2:4])[0]
    segment = ip[begin : total or len(ip)]
    if len(segment) < 20:
        return None
    payload = segment[(segment[12] >> 4) * 4 :]
    if not payload:
        return None
    src, dst = (".".join(map(str, ip[i : i + 4])) for i in (12, 16))
    return src, struct.unpack(">H", segment[:2])[0], dst, struct.unpack(">H", segment[2:4])[0], bytes(payload)


def packets(f: BinaryIO) -> Iterator[tuple[int, float, bytes]]:
    """Link type, time and bytes of each packet of a capture."""
    head = f.read(4)
    if len(head) < 4:
        return
    values = {struct.unpack(o + "I", head)[0] for o in "<>"}
    if _NEXT_GENERATION in values:
        yield from _blocks(f, head)
    elif values & set(_MAGIC):
        yield from _classic(f, head)
    else:
        raise ValueError("not a packet capture")


class _Part(InputPartition):
    """Packets from number seq on of a file, from byte begin to byte end; the whole file if end is 0."""

    def __init__(self, path: str, begin: int = 0, end: int = 0, seq: int = 0):
        self.path, self.begin, self.end, self.seq = path, begin, end, seq


def _parts(system, path: str, size: int) -> list[_Part]:
    if size <= SPLIT:
        return [_Part(path)]
    with system.open_input_file(path) as f:
        head = f.read(4)
        if not {struct.unpack(o + "I", head)[0] for o in "<>"} & set(_MAGIC):
            return [_Part(path)]
        order, out, at, begin, seq, first = _order(head)[0], [], 24, 24, 0, 0
        while at + 16 <= size:
            f.seek(at + 8)
            at += 16 + struct.unpack(order + "I", f.read(4))[0]
            seq += 1
            if at - begin >= SPLIT:
                out.append(_Part(path, begin, at, first))
                begin, first = at, seq
        return [*out, _Part(path, begin, size, first)] if begin < size else out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[_Part]:
        from pyarrow.fs import FileSelector, FileType

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == FileType.Directory:
            found = system.get_file_info(FileSelector(path))
        elif info.type == FileType.File:
            found = [info]
        else:
            above = system.get_file_info(FileSelector(os.path.dirname(path), allow_not_found=True))
            found = [x for x in above if fnmatch.fnmatch(x.path, path)]
        found = sorted((x for x in found if x.type == FileType.File), key=lambda x: x.path)
        if not found:
            raise FileNotFoundError(self.path)
        return [p for x in found for p in _parts(system, x.path, x.size)]

    def read(self, partition: _Part):
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as whole:
            head = whole.read(24) if partition.end else b""
            whole.seek(partition.begin)
            f = _Buffered(whole, partition.end)
            if partition.end:
                order, scale = _order(head[:4])
                rows = _records(f, order, scale, struct.unpack(order + "I", head[20:])[0] & 0xFFFF)
            else:
                rows = packets(f)
            for seq, (link, ts, data) in enumerate(rows, partition.seq):
                if found := tcp(link, data):
                    src, sport, dst, dport, payload = found
                    yield partition.path, seq, src, sport, dst, dport, ts, payload


class _Buffered:
    """Reads of a few bytes each from reads of a megabyte, up to byte end."""

    def __init__(self, f, end: int = 0):
        self.f, self.left, self.held, self.at = f, end - f.tell() if end else None, b"", 0

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            want = max(1 << 20, n)
            more = self.f.read(want if self.left is None else min(want, self.left))
            if self.left is not None:
                self.left -= len(more)
            if not more:
                break
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


class TcpPcap(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tcp_pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str):
    spark.dataSource.register(TcpPcap)
    return spark.read.format("tcp_pcap").load(path)


def read_binary(spark: SparkSession, path: str):
    """The same rows of captures in any store that Spark reads; each file is held in memory whole."""
    import io

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(name, seq, *found[:4], ts, found[4]) for seq, (link, ts, raw) in enumerate(packets(io.BytesIO(data.as_py()))) if (found := tcp(link, raw))]
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.binary())
                names = ("file", "seq", "src_ip", "src_port", "dst_ip", "dst_port", "ts", "payload")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, SCHEMA)
