"""A parser of GRIB edition 2 after the published code tables: keys, coordinates and values of messages.

Read: latitude/longitude and Gaussian grids (others give no latitude and longitude), product
templates 0, 1, 8 and 11, simple, IEEE and complex packing with and without spatial differences, and
bitmaps. Parameters and levels that are not among the tables below are named ``unknown``. Data in
other packings raise ``Unsupported`` when they are decoded; their keys are read all the same.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import numpy as np

from chunkloom.sources.binary import Pair, _array, _group, grib_messages


class Unsupported(RuntimeError):
    """A feature of the format that this parser doesn't read."""


#: (discipline, category, number): short name, name of the variable, long name, units. Fixed values.
PARAMETERS = {
    (0, 0, 0): ("t", "t", "Temperature", "K"),
    (0, 0, 2): ("pt", "pt", "Potential temperature", "K"),
    (0, 0, 4): ("tmax", "tmax", "Maximum temperature", "K"),
    (0, 0, 5): ("tmin", "tmin", "Minimum temperature", "K"),
    (0, 0, 6): ("dpt", "dpt", "Dew point temperature", "K"),
    (0, 0, 10): ("lhtfl", "lhtfl", "Latent heat net flux", "W m**-2"),
    (0, 0, 11): ("shtfl", "shtfl", "Sensible heat net flux", "W m**-2"),
    (0, 1, 0): ("q", "q", "Specific humidity", "kg kg**-1"),
    (0, 1, 1): ("r", "r", "Relative humidity", "%"),
    (0, 1, 3): ("pwat", "pwat", "Precipitable water", "kg m**-2"),
    (0, 1, 7): ("prate", "prate", "Precipitation rate", "kg m**-2 s**-1"),
    (0, 1, 8): ("tp", "tp", "Total Precipitation", "kg m**-2"),
    (0, 1, 10): ("acpcp", "acpcp", "Convective precipitation (water)", "kg m**-2"),
    (0, 1, 11): ("sde", "sde", "Snow depth", "m"),
    (0, 1, 13): ("sdwe", "sdwe", "Water equivalent of accumulated snow depth (deprecated)", "kg m**-2"),
    (0, 1, 22): ("clwmr", "clwmr", "Cloud mixing ratio", "kg kg**-1"),
    (0, 2, 0): ("wdir", "wdir", "Wind direction", "Degree true"),
    (0, 2, 1): ("ws", "ws", "Wind speed", "m s**-1"),
    (0, 2, 2): ("u", "u", "U component of wind", "m s**-1"),
    (0, 2, 3): ("v", "v", "V component of wind", "m s**-1"),
    (0, 2, 8): ("w", "w", "Vertical velocity", "Pa s**-1"),
    (0, 2, 9): ("wz", "wz", "Geometric vertical velocity", "m s**-1"),
    (0, 2, 10): ("absv", "absv", "Absolute vorticity", "s**-1"),
    (0, 2, 22): ("gust", "gust", "Wind speed (gust)", "m s**-1"),
    (0, 3, 0): ("pres", "pres", "Pressure", "Pa"),
    (0, 3, 1): ("prmsl", "prmsl", "Pressure reduced to MSL", "Pa"),
    (0, 3, 5): ("gh", "gh", "Geopotential height", "gpm"),
    (0, 4, 7): ("dswrf", "dswrf", "Downward short-wave radiation flux", "W m**-2"),
    (0, 4, 8): ("uswrf", "uswrf", "Upward short-wave radiation flux", "W m**-2"),
    (0, 5, 3): ("dlwrf", "dlwrf", "Downward long-wave radiation flux", "W m**-2"),
    (0, 5, 4): ("ulwrf", "ulwrf", "Upward long-wave radiation flux", "W m**-2"),
    (0, 6, 1): ("tcc", "tcc", "Total Cloud Cover", "%"),
    (0, 7, 6): ("cape", "cape", "Convective available potential energy", "J kg**-1"),
    (0, 7, 7): ("cin", "cin", "Convective inhibition", "J kg**-1"),
    (0, 19, 0): ("vis", "vis", "Visibility", "m"),
    (2, 0, 0): ("lsm", "lsm", "Land-sea mask", "(0 - 1)"),
    (2, 0, 2): ("st", "st", "Soil temperature", "K"),
    (2, 0, 192): ("soilw", "soilw", "Volumetric soil moisture content", "Proportion"),
    (10, 0, 3): ("swh", "swh", "Significant height of combined wind waves and swell", "m"),
    (10, 3, 0): ("wtmp", "wtmp", "Water temperature", "K"),
}
#: (first surface, second surface or 255): type of level. Fixed values.
LEVELS = {
    (1, 255): "surface",
    (1, 8): "atmosphere",
    (4, 255): "isothermZero",
    (6, 255): "maxWind",
    (7, 255): "tropopause",
    (8, 255): "nominalTop",
    (10, 255): "atmosphere",
    (100, 255): "isobaricInhPa",
    (101, 255): "meanSea",
    (102, 255): "heightAboveSea",
    (103, 255): "heightAboveGround",
    (103, 103): "heightAboveGroundLayer",
    (104, 255): "sigma",
    (104, 104): "sigmaLayer",
    (105, 255): "hybrid",
    (105, 105): "hybridLayer",
    (106, 255): "depthBelowLand",
    (106, 106): "depthBelowLandLayer",
    (108, 255): "pressureFromGround",
    (108, 108): "pressureFromGroundLayer",
    (109, 255): "potentialVorticity",
    (200, 255): "atmosphereSingleLayer",
}
#: Kinds of statistics over an interval. Fixed values.
STATISTICS = {0: "avg", 1: "accum", 2: "max", 3: "min", 4: "diff", 5: "rms", 6: "sd", 7: "cov", 8: "diff", 9: "ratio"}
#: Seconds of the units of time. Fixed values.
TIME_UNITS = {0: 60, 1: 3600, 2: 86400, 10: 3 * 3600, 11: 6 * 3600, 12: 12 * 3600, 13: 1}
#: Grid templates with their names. Fixed values.
GRIDS = {0: "regular_ll", 1: "rotated_ll", 10: "mercator", 20: "polar_stereographic", 30: "lambert", 40: "regular_gg"}
MISSING = 255


def _signed(raw: bytes) -> int:
    """A number whose first bit is its sign."""
    v = int.from_bytes(raw, "big")
    top = 1 << (8 * len(raw) - 1)
    return -(v & (top - 1)) if v & top else v


def sections(data, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of a message's sections, the first one's 16 bytes included."""
    size = int.from_bytes(data[at + 8 : at + 16], "big")
    yield 0, bytes(data[at : at + 16])
    p = at + 16
    while p < at + size - 4:
        n = int.from_bytes(data[p : p + 4], "big")
        if n < 5 or p + n > at + size - 4:
            raise ValueError(f"a broken section at byte {p}")
        yield data[p + 4], bytes(data[p : p + n])
        p += n


def fields(data, at: int = 0) -> Iterator[dict[int, bytes]]:
    """The sections in force for each field of a message; one without a bitmap of its own may use the last one."""
    now: dict[int, bytes] = {}
    for n, raw in sections(data, at):
        if n == 6 and raw[5] == 254 and 6 in now:
            continue
        now[n] = raw
        if n == 7:
            yield dict(now)


def _grid(s: bytes) -> dict:
    template = int.from_bytes(s[12:14], "big")
    out = {"gridType": GRIDS.get(template, f"template_{template}"), "numberOfPoints": int.from_bytes(s[6:10], "big")}
    if template in (0, 1, 40):
        nx, ny = struct.unpack(">II", s[30:38])
        basic, sub = int.from_bytes(s[38:42], "big"), int.from_bytes(s[42:46], "big")
        unit = 1e-6 if basic in (0, 0xFFFFFFFF) or sub in (0, 0xFFFFFFFF) else basic / sub
        la1, lo1 = _signed(s[46:50]) * unit, _signed(s[50:54]) * unit
        la2, lo2 = _signed(s[55:59]) * unit, _signed(s[59:63]) * unit
        scan = s[71]
        out |= {"Nx": nx, "Ny": ny, "scan": scan, "first": (la1, lo1), "last": (la2, lo2)}
        if template == 40:
            out["N"] = int.from_bytes(s[67:71], "big")
    elif template in (10, 20, 30):
        nx, ny = struct.unpack(">II", s[30:38])
        out |= {"Nx": nx, "Ny": ny, "scan": s[{10: 59, 20: 64, 30: 64}[template]]}
    else:
        out |= {"Nx": out["numberOfPoints"], "Ny": 1, "scan": 0}
    return out


def axes(grid: dict) -> tuple[np.ndarray, np.ndarray] | None:
    """(latitudes, longitudes) of a regular grid in the order of its rows and columns."""
    if grid["gridType"] not in ("regular_ll", "regular_gg"):
        return None
    (la1, lo1), (la2, lo2) = grid["first"], grid["last"]
    nx, ny = grid["Nx"], grid["Ny"]
    if lo2 < lo1 and not grid["scan"] & 0x80:
        lo2 += 360
    lon = lo1 + (lo2 - lo1) * np.arange(nx) / max(1, nx - 1)
    if grid["gridType"] == "regular_ll":
        return la1 + (la2 - la1) * np.arange(ny) / max(1, ny - 1), lon
    whole = np.degrees(np.arcsin(np.polynomial.legendre.leggauss(2 * grid["N"])[0]))[::-1]  # from the north
    start = int(np.abs(whole - max(la1, la2)).argmin())
    lat = whole[start : start + ny]
    return (lat if la1 >= la2 else lat[::-1]), lon


def _scaled(s: bytes, at: int) -> float | None:
    """A level's value: a scale factor and a scaled number, either of which may be missing."""
    if s[at + 1 : at + 5] == b"\xff\xff\xff\xff":
        return None
    return _signed(s[at + 1 : at + 5]) * 10.0 ** -(0 if s[at] == MISSING else _signed(s[at : at + 1]))


def _product(s: bytes, discipline: int) -> dict:
    template = int.from_bytes(s[7:9], "big")
    if template not in (0, 1, 8, 11):
        raise Unsupported(f"product template {template}")
    key = (discipline, s[9], s[10])
    short, var, name, units = PARAMETERS.get(key, ("unknown", "unknown", "unknown", "unknown"))
    unit = TIME_UNITS.get(s[17])
    step = _signed(s[18:22]) * unit if unit else None
    one, two = s[22], s[28]
    level_type = LEVELS.get((one, two), "unknown")
    level, top = _scaled(s, 23), _scaled(s, 29) if two != MISSING else None
    if one == 100 and level is not None:
        level /= 100  # from Pa to hPa
    out = {"parameter": key, "shortName": short, "varname": var, "name": name, "units": units, "typeOfLevel": level_type, "level": level, "second_level": top, "stepType": "instant", "start_s": step, "step_s": step}
    p = 34
    if template in (1, 11):
        out |= {"number": s[35], "totalNumber": s[36]}
        p = 37
    if template in (8, 11):
        ranges = s[p + 7]
        out["stepType"] = "accum"
        if ranges:
            q = p + 12
            out["stepType"] = STATISTICS.get(s[q], "unknown")
            length_unit = TIME_UNITS.get(s[q + 2])
            if length_unit and step is not None:
                out["step_s"] = step + int.from_bytes(s[q + 3 : q + 7], "big") * length_unit
    if short == "t" and level_type == "heightAboveGround" and level == 2:
        out |= {"shortName": "2t", "varname": "t2m", "name": "2 metre temperature"}
    if short in ("u", "v") and level_type == "heightAboveGround" and level == 10:
        out |= {"shortName": f"10{short}", "varname": f"{short}10", "name": f"10 metre {short.upper()} wind component"}
    if short == "pres" and level_type == "surface":
        out |= {"shortName": "sp", "varname": "sp", "name": "Surface pressure"}
    return out


def keys(now: dict[int, bytes]) -> dict:
    """What a field's sections say: names, level, times and grid."""
    one = now[1]
    y, mo, d, h, mi, s = struct.unpack(">HBBBBB", one[12:19])
    time = dt.datetime(y, mo, d, h, mi, min(s, 59))
    out = {"edition": 2, "discipline": now[0][6], "centre": int.from_bytes(one[5:7], "big"), "subCentre": int.from_bytes(one[7:9], "big"), "time": time}
    out |= _grid(now[3])
    out |= _product(now[4], now[0][6])
    out["packing"] = int.from_bytes(now[5][9:11], "big")
    out["valid_time"] = time + dt.timedelta(seconds=out["step_s"]) if out["step_s"] is not None else None
    return out


# --- values -----------------------------------------------------------------------------------


def _bits(raw: bytes, start: int, width: int, n: int) -> np.ndarray:
    """n unsigned numbers of ``width`` bits from bit ``start`` on."""
    if not width:
        return np.zeros(n, np.int64)
    first, last = start // 8, -(-(start + width * n) // 8)
    if width in (8, 16, 32) and start % 8 == 0:
        return np.frombuffer(raw, f">u{width // 8}", n, first).astype(np.int64)
    bit = np.unpackbits(np.frombuffer(raw, np.uint8, last - first, first))[start - 8 * first :][: width * n]
    out = np.zeros(n, np.int64)
    for column in bit.reshape(n, width).T:
        out = out << 1 | column
    return out


def _complex(s5: bytes, s7: bytes, n: int, spatial: bool) -> tuple[np.ndarray, np.ndarray]:
    """(scaled integers, which are missing) of groups with widths and lengths of their own."""
    bits = s5[19]
    missing = s5[22]
    groups = int.from_bytes(s5[31:35], "big")
    ref_width, width_bits = s5[35], s5[36]
    ref_length, step_length = int.from_bytes(s5[37:41], "big"), s5[41]
    last_length, length_bits = int.from_bytes(s5[42:46], "big"), s5[46]
    p, order, extra = 5, 0, []
    low = 0
    if spatial:
        order, size = s5[47], s5[48]
        for _ in range(order):
            extra.append(_signed(s7[p : p + size]))
            p += size
        low = _signed(s7[p : p + size])
        p += size
    at = 8 * p
    firsts = _bits(s7, at, bits, groups)
    at = -(-(at + bits * groups) // 8) * 8
    widths = _bits(s7, at, width_bits, groups) + ref_width
    at = -(-(at + width_bits * groups) // 8) * 8
    lengths = _bits(s7, at, length_bits, groups) * step_length + ref_length
    if groups:
        lengths[-1] = last_length
    at = -(-(at + length_bits * groups) // 8) * 8
    out = np.zeros(int(lengths.sum()), np.int64)
    gone = np.zeros(len(out), bool)
    k = 0
    for first, width, length in zip(firsts.tolist(), widths.tolist(), lengths.tolist(), strict=True):
        v = _bits(s7, at, width, length)
        at += width * length
        if missing:
            top = (1 << width) - 1 if width else (1 << bits) - 1
            special = v if width else np.full(length, first)
            gone[k : k + length] = (special == top) | ((special == top - 1) if missing == 2 else False)
        out[k : k + length] = v + first
        k += length
    if len(out) != n:
        raise ValueError(f"{len(out)} packed values where {n} should be")
    if spatial:
        real = np.flatnonzero(~gone)
        v = out[real] + low
        for i, x in enumerate(extra[: len(v)]):
            v[i] = x
        if order == 1:
            v = np.cumsum(v)
        elif order == 2 and len(v) > 1:
            v[1] -= v[0]  # the first difference, then sums of sums
            v[1:] = np.cumsum(v[1:])
            v = np.cumsum(v)
        out[real] = v
    return out, gone


def values(now: dict[int, bytes]) -> np.ndarray:
    """The field's values as doubles by row and column; missing ones are NaN."""
    s5, s7 = now[5], now[7]
    n, template = int.from_bytes(s5[5:9], "big"), int.from_bytes(s5[9:11], "big")
    if template in (0, 2, 3):
        (ref,) = struct.unpack(">f", s5[11:15])
        binary, decimal = _signed(s5[15:17]), _signed(s5[17:19])
        if template == 0:
            x, gone = _bits(s7, 40, s5[19], n), np.zeros(n, bool)
        else:
            x, gone = _complex(s5, s7, n, template == 3)
        packed = (ref + x * 2.0**binary) / 10.0**decimal
        packed[gone] = np.nan
    elif template == 4:
        packed = np.frombuffer(s7, {1: ">f4", 2: ">f8"}[s5[11]], n, 5).astype(float)
    else:
        raise Unsupported(f"data template {template}")
    grid = _grid(now[3])
    out = packed
    if 6 in now and now[6][5] == 0:
        mask = np.unpackbits(np.frombuffer(now[6], np.uint8, offset=6))[: grid["Nx"] * grid["Ny"]].astype(bool)
        out = np.full(grid["Nx"] * grid["Ny"], np.nan)
        out[mask] = packed
    elif 6 in now and now[6][5] not in (254, 255):
        raise Unsupported(f"predefined bitmap {now[6][5]}")
    scan = grid["scan"]
    if scan & 0x20:  # points run along columns
        return out.reshape(grid["Nx"], grid["Ny"]).T
    out = out.reshape(grid["Ny"], grid["Nx"])
    if scan & 0x10:  # every other row backwards
        out = out.copy()
        out[1::2] = out[1::2, ::-1]
    return out


def decoded(raw: bytes, var: str, field: int = 0) -> np.ndarray:
    """The array a message holds for a name: latitudes, longitudes, or the field's values."""
    at = raw.find(b"GRIB")
    for k, now in enumerate(fields(raw, max(0, at))):
        if k == field:
            if var in ("latitude", "longitude"):
                pair = axes(_grid(now[3]))
                if pair is None:
                    raise Unsupported(f"coordinates of a {_grid(now[3])['gridType']} grid")
                return pair[var == "longitude"]
            return values(now)
    raise ValueError(f"the message has no field {field}")


# --- references -------------------------------------------------------------------------------

#: Attributes of coordinates. Fixed values.
COORD_ATTRS = {
    "latitude": {"units": "degrees_north", "standard_name": "latitude", "long_name": "latitude"},
    "longitude": {"units": "degrees_east", "standard_name": "longitude", "long_name": "longitude"},
    "time": {"units": "seconds since 1970-01-01T00:00:00", "calendar": "proleptic_gregorian", "standard_name": "forecast_reference_time", "long_name": "initial time of forecast"},
    "step": {"units": "hours", "standard_name": "forecast_period", "long_name": "time since forecast_reference_time"},
    "valid_time": {"units": "seconds since 1970-01-01T00:00:00", "calendar": "proleptic_gregorian", "standard_name": "time", "long_name": "time"},
}


def seconds(t: dt.datetime) -> int:
    return int((t - dt.datetime(1970, 1, 1)).total_seconds())


def message_pairs(k: dict, field: int, offset: int, size: int) -> Iterator[Pair]:
    """References of one field as a small dataset: its values, level, times and axes."""
    var, level = k["varname"], k["typeOfLevel"]
    pair = axes(k)
    has_level = k["level"] is not None
    coords = [*([level] if has_level else []), "time", *(["step", "valid_time"] if k["step_s"] is not None else []), *(["latitude", "longitude"] if pair else [])]
    yield from _group("", {"GRIB_edition": 2, "GRIB_centre": k["centre"], "GRIB_subCentre": k["subCentre"], "coordinates": " ".join(coords)})
    attrs = {"GRIB_name": k["name"], "GRIB_shortName": k["shortName"], "GRIB_units": k["units"], "GRIB_typeOfLevel": level, "GRIB_stepType": k["stepType"], "GRIB_gridType": k["gridType"], "GRIB_Nx": k["Nx"], "GRIB_Ny": k["Ny"], "long_name": k["name"], "units": k["units"]}
    dims = ["latitude", "longitude"] if pair else ["y", "x"]
    shape = [k["Ny"], k["Nx"]]
    codec = {"id": "grib", "var": var, "dtype": "<f8"} | ({"field": field} if field else {})
    yield from _array(var, shape, shape, "<f8", dims, attrs, "NaN", None, [codec])
    yield f"{var}/0.0", (offset, size)
    scalars: list[tuple[str, object, str]] = [("time", seconds(k["time"]), "<i8")]
    if has_level:
        scalars.append((level, float(k["level"]), "<f8"))
    if k["step_s"] is not None:
        scalars += [("step", k["step_s"] / 3600, "<f8"), ("valid_time", seconds(k["valid_time"]), "<i8")]
    for name, v, dtype in scalars:
        yield from _array(name, [], [], dtype, [], COORD_ATTRS.get(name, {}), None if dtype == "<i8" else "NaN")
        yield f"{name}/0", np.array(v, dtype).tobytes()
    for name, v in zip(("latitude", "longitude"), pair or (), strict=False):
        yield from _array(name, [len(v)], [len(v)], "<f8", [name], COORD_ATTRS[name], "NaN")
        yield f"{name}/0", v.astype("<f8").tobytes()


def wanted(k: dict, keep: dict[str, object] | None) -> bool:
    """Whether every key of a filter is there with its value, or one of its list."""
    return all(n in k and (k[n] in v if isinstance(v, (list, tuple, set)) else k[n] == v) for n, v in (keep or {}).items())


def messages(data, skip: int = 0, keep: dict[str, object] | None = None) -> Iterator[tuple[int, int, int, int, dict]]:
    """(number from 1, field, offset, size, keys) of the messages of edition 2 that a filter keeps."""
    for n, (offset, size, edition, _, _) in enumerate(grib_messages(data, skip), 1):
        if edition != 2:
            raise Unsupported(f"edition {edition}")
        for field, now in enumerate(fields(data, offset)):
            k = keys(now)
            if wanted(k, keep):
                yield n, field, offset, size, k
