"""Ethernet, IPv4 and transport decoding as column expressions over a binary column, and frame builders."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import PROTOCOLS
from .scalars import tcp_flags


def uint(raw: Column, at: Column | int, n: int) -> Column:
    """n bytes from offset ``at`` (from 0), big-endian."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(raw.substr((at + 1).cast("int"), F.lit(n))), 16, 10).cast("long")


def rest(raw: Column, at: Column) -> Column:
    return raw.substr((at + 1).cast("int"), F.lit(1 << 30))


def dotted(raw: Column, at: Column) -> Column:
    return F.concat_ws(".", *[uint(raw, at + i, 1).cast("string") for i in range(4)])


def decode(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds status (ok, non_ipv4, malformed) and the packet's fields; columns nobody reads are pruned.

    Up to two VLAN tags are followed. IP fragments are not handled. The payload runs to the frame's end.
    """
    r, n = F.col(raw), F.length(raw)
    tagged = lambda at: uint(r, at, 2).isin(0x8100, 0x88A8, 0x9100)
    l3 = F.when(tagged(12) & tagged(16), 22).when(tagged(12), 18).otherwise(14)
    df = df.withColumn("_l3", F.when(n >= 14, l3))
    at = F.col("_l3")
    version, ihl = F.shiftright(uint(r, at, 1), 4), uint(r, at, 1).bitwiseAND(F.lit(15)) * 4
    proto = uint(r, at + 9, 1)
    l4 = at + ihl
    need = F.when(proto == 6, 20).when(proto == 17, 8).when(proto == 1, 4).otherwise(0)
    status = (
        F.when(n < 14, "malformed").when(uint(r, at - 2, 2) != 0x0800, "non_ipv4").when(n < at + 20, "malformed")
        .when((version != 4) | (ihl < 20) | (n < l4), "malformed").when(n < l4 + need, "malformed").otherwise("ok")
    )
    df = df.withColumn("status", F.when(r.isNull(), "malformed").otherwise(status))
    ok = F.col("status") == "ok"
    tcp, udp, icmp = ok & (proto == 6), ok & (proto == 17), ok & (proto == 1)
    name = F.lit("OTHER")
    for k, v in PROTOCOLS.items():
        name = F.when(proto == k, v).otherwise(name)
    bits = uint(r, l4 + 13, 1)
    head = F.greatest(F.lit(20), F.shiftright(uint(r, l4 + 12, 1), 4) * 4)
    flags = F.when(tcp, tcp_flags(bits)).when(ok, "-")
    sport = F.when(tcp | udp, uint(r, l4, 2)).when(ok, 0)
    dport = F.when(tcp | udp, uint(r, l4 + 2, 2)).when(ok, 0)
    itype, icode = F.when(icmp, uint(r, l4, 1)), F.when(icmp, uint(r, l4 + 1, 1))
    payload = F.when(tcp, rest(r, l4 + head)).when(udp, rest(r, l4 + 8)).when(icmp, rest(r, l4 + 4)).when(ok, rest(r, l4))
    info = (
        F.when(tcp, F.format_string("%d -> %d [%s] Seq=%d Win=%d", sport, dport, flags, uint(r, l4 + 4, 4), uint(r, l4 + 14, 2)))
        .when(udp, F.format_string("%d -> %d Len=%d", sport, dport, uint(r, l4 + 4, 2)))
        .when(icmp, F.format_string("ICMP type=%d code=%d", itype, icode)).when(ok, F.format_string("IP protocol %d", proto))
    )
    cols = {
        "src": F.when(ok, dotted(r, at + 12)), "dst": F.when(ok, dotted(r, at + 16)), "src_mac": F.when(ok, F.lower(F.hex(r.substr(7, 6)))), "dst_mac": F.when(ok, F.lower(F.hex(r.substr(1, 6)))),
        "protocol_num": F.when(ok, proto).cast("int"), "proto": F.when(ok, name), "ttl": F.when(ok, uint(r, at + 8, 1)).cast("int"), "ip_total_length": F.when(ok, uint(r, at + 2, 2)).cast("int"), "length": n,
        "sport": sport.cast("int"), "dport": dport.cast("int"), "flags": flags, "payload": payload, "info": info,
        "seq": F.when(tcp, uint(r, l4 + 4, 4)), "ack": F.when(tcp, uint(r, l4 + 8, 4)), "window": F.when(tcp, uint(r, l4 + 14, 2)).cast("int"),
        "icmp_type": itype.cast("int"), "icmp_code": icode.cast("int"),
    }
    return df.withColumns(cols).drop("_l3")


def decode_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").count()


def _ip(proto: int, body: bytes, src: str, dst: str, ttl: int = 64) -> bytes:
    address = lambda x: bytes(map(int, x.split(".")))
    head = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 1, 0, ttl, proto, 0) + address(src) + address(dst)
    return b"\x02\x00\x00\x00\x00\x02" + b"\x02\x00\x00\x00\x00\x01" + b"\x08\x00" + head + body


def build_tcp(sport: int, dport: int, flags: int = 0x02, data: bytes = b"", src: str = "192.168.1.10", dst: str = "192.168.1.1", seq: int = 0, window: int = 8192) -> bytes:
    return _ip(6, struct.pack("!HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, window, 0, 0) + data, src, dst)


def build_udp(sport: int, dport: int, data: bytes = b"", src: str = "192.168.1.10", dst: str = "192.168.1.1") -> bytes:
    return _ip(17, struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data, src, dst)


def build_icmp(kind: int = 8, code: int = 0, data: bytes = b"", src: str = "192.168.1.10", dst: str = "192.168.1.1") -> bytes:
    return _ip(1, struct.pack("!BBH", kind, code, 0) + data, src, dst)
