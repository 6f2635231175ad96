"""Column expressions for the wire encodings: varints, msgpack, protobuf framing, packed ids.

Bytes are assembled as hexadecimal text inside the expression and turned into
binary once, so whole frames are built without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    return F.when(n >= 0, n * 2).otherwise(n * -2 - 1)


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, F.floor(z / 2)).otherwise(-F.floor((z + 1) / 2)).cast("long")


def hex_byte(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2, "0")


def hex_wide(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), digits, "0")


def varint_size(n: Column) -> Column:
    """Bytes of n >= 0 as LEB128."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(n < F.lit(1 << (7 * k)), F.lit(k)).otherwise(out)
    return out


def varint_hex(n: Column) -> Column:
    """LEB128 of n >= 0, as hexadecimal text."""
    last = varint_size(n) - 1
    return F.array_join(
        F.transform(F.sequence(F.lit(0), last), lambda i: hex_byte(F.pmod(F.call_function("shiftright", n.cast("long"), i * 7), F.lit(128)) + F.when(i < last, 128).otherwise(0))), ""
    )


def msgpack_uint_size(n: Column) -> Column:
    return F.when(n < 1 << 7, 1).when(n < 1 << 8, 2).when(n < 1 << 16, 3).when(n < F.lit(1 << 32), 5).otherwise(9)


def msgpack_uint_hex(n: Column) -> Column:
    return (
        F.when(n < 1 << 7, hex_byte(n))
        .when(n < 1 << 8, F.concat(F.lit("CC"), hex_byte(n)))
        .when(n < 1 << 16, F.concat(F.lit("CD"), hex_wide(n, 4)))
        .when(n < F.lit(1 << 32), F.concat(F.lit("CE"), hex_wide(n, 8)))
        .otherwise(F.concat(F.lit("CF"), hex_wide(n, 16)))
    )


def msgpack_str_size(length: Column) -> Column:
    return length + F.when(length < 32, 1).when(length < 256, 2).when(length < 65536, 3).otherwise(5)


def msgpack_str_hex(s: Column) -> Column:
    n = F.octet_length(s)
    head = F.when(n < 32, hex_byte(n + 0xA0)).when(n < 256, F.concat(F.lit("D9"), hex_byte(n))).otherwise(F.concat(F.lit("DA"), hex_wide(n, 4)))
    return F.concat(head, F.hex(s))


def msgpack_bin_size(length: Column) -> Column:
    return length + F.when(length < 256, 2).when(length < 65536, 3).otherwise(5)


def msgpack_array_head_size(n: Column) -> Column:
    return F.when(n < 16, 1).when(n < 65536, 3).otherwise(5)


def msgpack_array_hex(ids: Column) -> Column:
    n = F.size(ids)
    head = F.when(n < 16, hex_byte(n + 0x90)).when(n < 65536, F.concat(F.lit("DC"), hex_wide(n, 4))).otherwise(F.concat(F.lit("DD"), hex_wide(n, 8)))
    return F.concat(head, F.array_join(F.transform(ids, msgpack_uint_hex), ""))


def msgpack_frame_hex(ids: Column, done: Column, reason: Column) -> Column:
    """{"ids": [...], "done": bool, "finish_reason"?: str}."""
    pairs = F.when(reason.isNull(), 2).otherwise(3)
    return F.concat(
        hex_byte(pairs + 0x80), msgpack_str_hex(F.lit("ids")), msgpack_array_hex(ids), msgpack_str_hex(F.lit("done")), F.when(done, "C3").otherwise("C2"),
        F.when(reason.isNull(), "").otherwise(F.concat(msgpack_str_hex(F.lit("finish_reason")), msgpack_str_hex(reason))),
    )


def protobuf_frame_hex(ids: Column, done: Column, reason: Column, always_done: bool = False) -> Column:
    """Length-prefixed message: 1 packed ids, 2 done, 3 finish reason; always_done writes field 2 when false too."""
    packed = F.array_join(F.transform(ids, varint_hex), "")
    one = F.when(F.size(ids) > 0, F.concat(F.lit("0A"), varint_hex(F.length(packed) / 2), packed)).otherwise("")
    two = F.when(done, "1001").otherwise("1000" if always_done else "")
    three = F.when(F.coalesce(F.length(reason), F.lit(0)) > 0, F.concat(F.lit("1A"), varint_hex(F.octet_length(reason)), F.hex(reason))).otherwise("")
    body = F.concat(one, two, three)
    return F.concat(hex_wide(F.length(body) / 2, 8), body)


def typed_frame_hex(kind: Column, payload: Column) -> Column:
    """One byte of type, four of length, the payload."""
    return F.concat(hex_byte(kind), hex_wide(F.octet_length(payload), 8), F.hex(payload))


def packed_ids_hex(ids: Column) -> Column:
    """Ids as unsigned 32-bit big-endian integers."""
    return F.array_join(F.transform(ids, lambda i: hex_wide(i, 8)), "")


def unpack_ids(packed: Column) -> Column:
    """The reverse, from hexadecimal text."""
    count = F.floor(F.length(packed) / 8).cast("int")
    spots = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.conv(F.substring(packed, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def frame_sizes(ids: Column, done: Column, reason: Column) -> dict[str, Column]:
    """Bytes of a frame in nine shapes, in closed form."""
    n, tail = F.size(ids), F.when(done, 1).otherwise(0)
    array = msgpack_array_head_size(n) + total(F.transform(ids, lambda i: msgpack_uint_size(i).cast("long")))
    var = total(F.transform(ids, lambda i: varint_size(i).cast("long")))
    deltas = total(F.transform(F.zip_with(F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b), lambda d: varint_size(zigzag(d)).cast("long")))
    word = F.coalesce(F.octet_length(reason), F.lit(0))
    why = F.when(reason.isNull(), 0).otherwise(msgpack_str_size(word))
    keyed = lambda size: F.when(reason.isNull(), 0).otherwise(size) + why
    pb_ids = F.when(n > 0, 1 + varint_size(var) + var).otherwise(0)
    pb_why = F.when(word > 0, 1 + varint_size(word) + word).otherwise(0)
    delta_body = F.when(n > 0, 1 + msgpack_uint_size(F.get(ids, F.lit(0)))).otherwise(0) + F.when(n > 1, 1 + msgpack_bin_size(deltas)).otherwise(0)
    return {
        "current": 1 + 4 + array + 5 + 1 + keyed(14),
        "short_keys": 1 + 2 + array + 2 + 1 + keyed(2),
        "int_keys": 1 + 1 + array + 1 + 1 + keyed(1),
        "int_keys_sparse": 1 + 1 + array + 2 * tail + keyed(1),
        "positional": 1 + array + 1 + why,
        "varint_bin": 1 + 1 + msgpack_bin_size(var) + 2 * tail + keyed(1),
        "varint_delta": 1 + delta_body + 2 * tail + keyed(1),
        "protobuf": 4 + pb_ids + 2 * tail + pb_why,
        "protobuf_always_done": 4 + pb_ids + 2 + pb_why,
    }


TOOL_CALL = "struct<name:string,arguments_json:string,id:string>"


def tool_call_msgpack_hex(call: Column) -> Column:
    """A tool call as a map: arguments_json always, name and id where there are any."""
    extra = [(n, call[n]) for n in ("name", "id")]
    n = 1 + sum(F.when(c.isNotNull(), 1).otherwise(0) for _, c in extra)
    pair = lambda k, c: F.concat(msgpack_str_hex(F.lit(k)), msgpack_str_hex(c))
    parts = [pair("arguments_json", F.coalesce(call["arguments_json"], F.lit("")))] + [F.when(c.isNull(), "").otherwise(pair(k, c)) for k, c in extra]
    return F.concat(hex_byte(n + 0x80), *parts)


def msgpack_frame_with_calls_hex(ids: Column, done: Column, reason: Column, calls: Column) -> Column:
    """A frame whose last entry lists its tool calls, if it has any (fifteen at most)."""
    plain = msgpack_frame_hex(ids, done, reason)
    listed = F.concat(msgpack_str_hex(F.lit("tool_calls")), hex_byte(F.size(calls) + 0x90), F.array_join(F.transform(calls, tool_call_msgpack_hex), ""))
    more = F.concat(hex_byte(F.when(reason.isNull(), 2).otherwise(3) + 0x81), F.substring(plain, 3, 2**31 - 1), listed)
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, more).otherwise(plain)


def tool_call_protobuf_hex(call: Column) -> Column:
    """A tool call as field 4: 1 name, 2 arguments, 3 id; absent ones are left out."""

    def field(tag: str, c: Column) -> Column:
        return F.when(c.isNull(), "").otherwise(F.concat(F.lit(tag), varint_hex(F.octet_length(c)), F.hex(c)))

    body = F.concat(field("0A", call["name"]), field("12", F.coalesce(call["arguments_json"], F.lit(""))), field("1A", call["id"]))
    return F.concat(F.lit("22"), varint_hex(F.length(body) / 2), body)
