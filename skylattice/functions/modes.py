"""Mode S and ADS-B messages on columns of bytes.

semantics="corrected" follows the published standard; "reference" keeps two deviations of an earlier
engine, for comparison: truncated remainders in CPR, and no de-interleaving of 25 ft altitudes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice.consts import CRC24_POLY, FEET_TO_METERS, NUC_BY_TYPE


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        r = byte << 16
        for _ in range(8):
            r = (r << 1) ^ (CRC24_POLY if r & 0x800000 else 0)
        out.append(r & 0xFFFFFF)
    return out


#: Latitudes where the number of longitude zones falls, from the zone formula, with 59 zones at the equator.
def nl_breaks() -> list[float]:
    import math

    out = []
    for zones in range(59, 1, -1):
        a = 1 - math.cos(math.pi / 30)
        out.append(math.degrees(math.acos(math.sqrt(a / (1 - math.cos(2 * math.pi / zones))))) if zones > 2 else 87.0)
    return out


def byte_at(payload: Column, i: int) -> Column:
    """Byte i (from 0) as an int."""
    return F.conv(F.hex(F.substring(payload, i + 1, 1)), 16, 10).cast("int")


def crc24_residual(payload: Column) -> Column:
    """The remainder of all but the last three bytes, xored with those; 0 below four bytes."""
    table = F.array(*(F.lit(x) for x in _crc_table()))
    digits = F.hex(payload)
    size = F.octet_length(payload)
    value = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    remainder = F.aggregate(
        F.sequence(F.lit(0), size - 4),
        F.lit(0),
        lambda r, i: F.shiftleft(r.bitwiseAND(0xFFFF), 8).bitwiseXOR(F.get(table, F.shiftright(r, 16).bitwiseAND(0xFF).bitwiseXOR(value(i)))),
    )
    tail = F.conv(F.right(digits, F.lit(6)), 16, 10).cast("int")
    return F.when(size >= 4, remainder.bitwiseXOR(tail)).otherwise(0)


def downlink_format(payload: Column) -> Column:
    return F.shiftright(byte_at(payload, 0), 3).bitwiseAND(31)


def correlation_icao(payload: Column, residual: Column) -> Column:
    """The address that groups copies of a transmission: sent in clear, or the checksum's residual."""
    df, size = downlink_format(payload), F.octet_length(payload)
    clear = (df.isin(17, 18) & (size >= 14)) | ((df == 11) & (size >= 7))
    hidden = (df.isin(20, 21) & (size >= 14)) | (df.isin(4, 5) & (size >= 7))
    return F.when(clear, F.upper(F.hex(F.substring(payload, 2, 3)))).when(hidden, F.lpad(F.hex(residual), 6, "0"))


def type_code(payload: Column) -> Column:
    return F.shiftright(byte_at(payload, 4), 3)


def is_position(payload: Column, residual: Column) -> Column:
    tc = type_code(payload)
    return (F.octet_length(payload) >= 14) & downlink_format(payload).isin(17, 18) & (residual == 0) & (tc.between(9, 18) | tc.between(20, 22))


def nuc(tc: Column) -> Column:
    out = F.lit(0)
    for level in sorted(set(NUC_BY_TYPE.values())):
        out = F.when(tc.isin(*(t for t, n in NUC_BY_TYPE.items() if n == level)), level).otherwise(out)
    return out


def altitude_raw(payload: Column) -> Column:
    """The 12 bits of altitude."""
    return F.shiftleft(byte_at(payload, 5), 4).bitwiseOR(F.shiftright(byte_at(payload, 6), 4))


def _bit(x: Column, i: int) -> Column:
    return F.shiftright(x, i).bitwiseAND(1)


def altitude_25ft(raw: Column, semantics: str = "corrected") -> Column:
    """Feet of a code with the Q bit; null without, or out of -1000..60000."""
    joined = F.shiftright(raw.bitwiseAND(0xFE0), 1).bitwiseOR(raw.bitwiseAND(0xF))
    feet = 25.0 * joined - 1000.0
    if semantics == "reference":
        feet = 25.0 * (raw.bitwiseAND(0xFEF) - 13)
    return F.when((_bit(raw, 4) == 1) & feet.between(-1000, 60000), feet)


def altitude_100ft(raw: Column) -> Column:
    """Feet of a Gillham code: 13 bits C1 A1 C2 A2 C4 A4 0 B1 Q B2 D2 B4 D4 after the M bit is put back.
    The five-hundreds are Gray code D2 D4 A1 A2 A4 B1 B2 B4, the hundreds C1 C2 C4."""
    # Bits of the 12-bit field from the top: C1 A1 C2 A2 C4 A4 B1 Q B2 D2 B4 D4.
    names = dict(zip("C1 A1 C2 A2 C4 A4 B1 Q B2 D2 B4 D4".split(), range(11, -1, -1)))
    b = {k: _bit(raw, i) for k, i in names.items()}
    value, seen = F.lit(0), F.lit(0)
    for name in "D2 D4 A1 A2 A4 B1 B2 B4".split():
        seen = seen.bitwiseXOR(b[name])
        value = value * 2 + seen
    c1 = b["C1"]
    c2 = c1.bitwiseXOR(b["C2"])
    c4 = c2.bitwiseXOR(b["C4"])
    hundreds = c1 * 4 + c2 * 2 + c4
    hundreds = F.when(hundreds == 7, 5).otherwise(hundreds)
    usable = (hundreds >= 1) & (hundreds <= 5)
    turned = F.when(value % 2 == 1, 6 - hundreds).otherwise(hundreds)
    feet = 500 * value + 100 * turned - 1300
    return F.when((_bit(raw, 4) == 0) & (raw != 0) & usable & (feet >= -1200), feet.cast("double"))


def altitude_m(raw: Column, semantics: str = "corrected") -> Column:
    return F.coalesce(altitude_25ft(raw, semantics), altitude_100ft(raw)) * F.lit(FEET_TO_METERS)


def cpr_fields(payload: Column) -> tuple[Column, Column, Column]:
    """(odd, lat17, lon17)."""
    b = [byte_at(payload, i) for i in range(6, 11)]
    lat = F.shiftleft(b[0].bitwiseAND(3), 15).bitwiseOR(F.shiftleft(b[1], 7)).bitwiseOR(F.shiftright(b[2], 1))
    lon = F.shiftleft(b[2].bitwiseAND(1), 16).bitwiseOR(F.shiftleft(b[3], 8)).bitwiseOR(b[4])
    return _bit(b[0], 2), lat, lon


def nl(lat: Column) -> Column:
    """Number of longitude zones."""
    breaks = F.array(*(F.lit(x) for x in nl_breaks()))
    return F.when(F.abs(lat) >= 87.0, 1).otherwise(59 - F.size(F.filter(breaks, lambda b: b <= F.abs(lat))))


def cpr_decode(lat_e: Column, lon_e: Column, lat_o: Column, lon_o: Column, odd_last: Column, semantics: str = "corrected") -> tuple[Column, Column]:
    """Global decoding of an even and an odd frame (17-bit fields); null where the zones differ."""
    size = 131072.0
    mod = F.pmod if semantics == "corrected" else (lambda a, m: a % m)
    y0, y1, x0, x1 = lat_e / size, lat_o / size, lon_e / size, lon_o / size
    j = F.floor(59.0 * y0 - 60.0 * y1 + 0.5).cast("double")
    turn = lambda a, most: F.when(a >= most, a - 360.0).otherwise(a)
    even = turn(F.lit(6.0) * (mod(j, F.lit(60.0)) + y0), 270.0)
    odd = turn(F.lit(360.0 / 59.0) * (mod(j, F.lit(59.0)) + y1), 270.0)
    zones_even, zones_odd = nl(even), nl(odd)
    lat = F.when(odd_last == 1, odd).otherwise(even)
    zones = zones_even.cast("double")
    m = F.floor(x0 * (zones - 1.0) - x1 * zones + 0.5).cast("double")
    ni = F.greatest(F.when(odd_last == 1, zones - 1.0).otherwise(zones), F.lit(1.0))
    lon = turn(F.lit(360.0) / ni * (mod(m, ni) + F.when(odd_last == 1, x1).otherwise(x0)), 180.0)
    good = (F.abs(even) <= 90.0) & (F.abs(odd) <= 90.0) & (zones_even == zones_odd)
    if semantics == "reference":
        good = (even <= 90.0) & (odd <= 90.0) & (zones_even == zones_odd)
    return F.when(good, lat), F.when(good, lon)
