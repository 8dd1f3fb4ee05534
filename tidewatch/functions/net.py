"""IP address and flow-key expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# TCP flag bits.
FIN, SYN, RST, ACK = 0x01, 0x02, 0x04, 0x10
SYN_ACK = SYN | ACK

# IP protocol numbers.
ICMP, TCP, UDP = 1, 6, 17

# Fixed pattern: characters an address or subnet literal may hold.
ADDRESS_PATTERN = r"^[\d.:/a-fA-F]+$"

# HTTP methods recognised in a request line.
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD"]


def has_flag(flags: Column, mask: int) -> Column:
    return F.coalesce(flags.bitwiseAND(F.lit(mask)) == mask, F.lit(False))


def endpoints(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> tuple[Column, Column]:
    """(lo, hi) endpoint structs, ordered by IP text and then port."""
    a = F.struct(src_ip.alias("ip"), src_port.alias("port"))
    b = F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    return F.least(a, b), F.greatest(a, b)


def flow_id(lo: Column, hi: Column, protocol: Column) -> Column:
    """Sixteen hex digits of the SHA-256 over the direction-free five-tuple."""
    text = F.concat_ws("|", lo["ip"], lo["port"].cast("string"), hi["ip"], hi["port"].cast("string"),
                       protocol.cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a long; null for anything else."""
    parts = [F.substring_index(ip, ".", 1), F.substring_index(F.substring_index(ip, ".", 2), ".", -1),
             F.substring_index(F.substring_index(ip, ".", -2), ".", 1), F.substring_index(ip, ".", -1)]
    octets = [p.try_cast("bigint") for p in parts]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*octets) <= 255), value)


def cidr_low(cidr: Column) -> Column:
    """First address of an IPv4 subnet literal (host bits allowed); a bare address is a /32."""
    size = _block_size(cidr)
    base = ipv4_number(F.split(cidr, "/")[0])
    return base - F.pmod(base, size)


def cidr_high(cidr: Column) -> Column:
    return cidr_low(cidr) + _block_size(cidr) - 1


def _block_size(cidr: Column) -> Column:
    length = F.coalesce(F.try_element_at(F.split(cidr, "/"), F.lit(2)).try_cast("int"), F.lit(32))
    return F.when(length.between(0, 32), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - length))


def subnet_of(ip: Column, prefix: int = 24) -> Column:
    """The `/prefix` network an IPv4 address belongs to, as text."""
    number = ipv4_number(ip)
    base = number - F.pmod(number, F.lit(1 << (32 - prefix)))
    octets = [F.pmod(F.shiftright(base, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat(F.concat_ws(".", *octets), F.lit(f"/{prefix}"))


_RANGE = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("lo", T.StringType()),
                       T.StructField("hi", T.StringType())])


@F.pandas_udf(_RANGE)
def address_range(text: pd.Series) -> pd.DataFrame:
    """Version, first and last address (32 hex digits, so text order is address order) of any v4 or
    v6 address or subnet; nulls when unreadable. Only needed for IPv6: v4 has the expressions above.
    """

    def one(value):
        try:
            net = ipaddress.ip_network(value, strict=False)
        except (ValueError, TypeError):
            return None, None, None
        return net.version, f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"

    return pd.DataFrame([one(v) for v in text], columns=["version", "lo", "hi"])


def label_safe(ip: Column) -> Column:
    """Address text usable as a metric label."""
    return F.translate(ip, ".:", "__")


def http_request(payload: Column) -> Column:
    """(method, path) of a request line, null when the text is no known request."""
    method = F.regexp_extract(payload, r"^([A-Z]+) (\S+)", 1)
    path = F.regexp_extract(payload, r"^([A-Z]+) (\S+)", 2)
    return F.when(method.isin(HTTP_METHODS), F.struct(method.alias("method"), path.alias("path")))
