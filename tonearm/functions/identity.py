"""A device's identity and the small files beside its library."""

import json
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start, prime, stand-in for 0 and the second half's mask of the identity; fixed values of the device.
BASIS, PRIME, NO_SEED, HALF = 0xCBF29CE484222325, 0x100000001B3, 0x123456789ABCDEF0, 0xA5A5A5A5A5A5A5A5
_LOW = (1 << 32) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _folded(h: Column, byte: Column) -> Column:
    """(h xor byte) * PRIME modulo 2**64, in halves of 32 bits so that nothing overflows."""
    h = h.bitwiseXOR(byte)
    low, high = h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32)
    small = PRIME & _LOW  # PRIME is 2**40 and this
    product = low * small
    top = (high * small + F.shiftrightunsigned(product, 32) + low * (1 << (40 - 32))).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(top, 32).bitwiseOR(product.bitwiseAND(F.lit(_LOW)))


def seed(data: Column) -> Column:
    """The 64-bit fold of an array of byte values (longs): track ids as four bytes each, least first, in their order, then the
    names of the playlists in theirs."""
    got = F.aggregate(data, F.lit(_signed(BASIS)).cast("long"), _folded)
    return F.when(got == 0, F.lit(NO_SEED)).otherwise(got)


def id_bytes(number: Column) -> Column:
    """Four bytes of a number, least first, as longs."""
    return F.array(*[F.shiftright(number.cast("long"), 8 * k).bitwiseAND(F.lit(255)) for k in range(4)])


def text_bytes(value: Column) -> Column:
    """The bytes of a text as longs."""
    coded = F.hex(F.encode(value, "UTF-8"))
    places = F.sequence(F.lit(0), F.octet_length(value) - 1)
    return F.when(F.octet_length(value) > 0, F.transform(places, lambda k: F.conv(F.substring(coded, 2 * k + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


def uuid_of(number: Column) -> Column:
    """32 hex digits: the seed, and the seed turned by 17 bits under a mask."""
    turned = F.shiftleft(number, 17).bitwiseOR(F.shiftrightunsigned(number, 47)).bitwiseXOR(F.lit(_signed(HALF)))
    return F.lower(F.concat(F.lpad(F.hex(number), 16, "0"), F.lpad(F.hex(turned), 16, "0")))


def library_id(number: Column) -> Column:
    """The 31 low bits of the seed."""
    return number.bitwiseAND(F.lit(0x7FFFFFFF))


def backup_json(uuid: str) -> str:
    return json.dumps({"uuid": uuid, "info": []}, indent=2)


def backup_column(uuid: Column) -> Column:
    return F.concat(F.lit('{\n  "uuid": "'), uuid, F.lit('",\n  "info": []\n}'))


def backup_name(number: Column) -> Column:
    return F.concat(F.lit("rbDevLibBaInfo_"), library_id(number).cast("string"), F.lit(".json"))


#: Parts of the settings file by place; fixed values of the format.
SETTINGS = ((0x00, struct.pack("<I", 96)), (0x04, b"PIONEER DJ"), (0x24, b"rekordbox"), (0x44, b"6.8.4"), (0x64, struct.pack("<III", 0x20, 0x12345678, 1)), (0x70, bytes([1] * 6)), (0x88, struct.pack("<I", 0xD016)))
SETTINGS_BYTES, PROFILE_BYTES, PROFILE_AT, PROFILE_NAME = 140, 160, 0x20, 31


def settings_file() -> bytes:
    out = bytearray(SETTINGS_BYTES)
    for at, part in SETTINGS:
        out[at : at + len(part)] = part
    return bytes(out)


def profile_file(name: str) -> bytes:
    """The profile's name, cut to 31 bytes, among zeros."""
    raw = name.encode()[:PROFILE_NAME]
    return (bytes(PROFILE_AT) + raw).ljust(PROFILE_BYTES, b"\0")


def profile_column(name: Column) -> Column:
    """The same as upper-case hex."""
    raw = F.substring(F.hex(F.encode(name, "UTF-8")), 1, 2 * PROFILE_NAME)
    return F.rpad(F.concat(F.lit("00" * PROFILE_AT), raw), 2 * PROFILE_BYTES, "0")


def sealed(plain: Column, key: Column) -> Column:
    """AES-256-GCM under a key of 32 bytes: a fresh nonce of 12 bytes, then the ciphertext and its tag."""
    return F.aes_encrypt(plain, key, F.lit("GCM"))


def opened(payload: Column, key: Column) -> Column:
    """The text again; null for a payload that is too short or was changed."""
    return F.when(F.octet_length(payload) >= 12, F.try_aes_decrypt(payload, key, F.lit("GCM")).cast("string"))
