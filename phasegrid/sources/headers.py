"""Text headers of GAMMA and ROI_PAC products.

Headers are small and few; they are read through Spark (so from any file
system) and parsed on the driver.
"""

from __future__ import annotations

import math
import re
from datetime import date, datetime

from pyspark.sql import SparkSession

from phasegrid.model import DAYS_PER_YEAR, SPEED_OF_LIGHT


class HeaderError(ValueError):
    """A header that can't be used."""


def read_texts(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The contents of small text files by path."""
    from pyspark.sql import functions as F

    rows = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("p"), "value").collect()
    found = {r["p"]: r["value"] for r in rows}
    by_tail = lambda p: next((v for k, v in found.items() if k.endswith(re.sub(r"^\w+:/*", "/", p).lstrip("."))), "")
    return {p: by_tail(p) for p in paths}


def file_list(spark: SparkSession, path: str) -> list[str]:
    """Paths in a list, one to a line; blank lines don't count."""
    from pyspark.sql import functions as F

    rows = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("v")).collect()
    return [x.strip() for r in rows for x in r["v"] if x.strip()]


def century(text: str) -> date:
    """yymmdd (years 50 to 99 are of the last century) or yyyymmdd."""
    if len(text) == 6:
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    return datetime.strptime(text, "%Y%m%d").date()


def dates_in(name: str) -> list[date]:
    """Dates in a file name: runs of eight digits, else of six."""
    tail = name.rsplit("/", 1)[-1]
    return [century(x) for x in re.findall(r"\d{8}", tail) or re.findall(r"\d{6}", tail)]


def fields(text: str) -> dict[str, list[str]]:
    """'key: values' lines of a GAMMA header."""
    out = {}
    for line in text.splitlines():
        key, colon, rest = line.partition(":")
        if colon and key.strip():
            out[key.strip()] = rest.split()
    return out


#: GAMMA key -> (our key, unit): fixed values of the format.
EPOCH_FIELDS = {
    "incidence_angle": ("INCIDENCE_DEGREES", "degrees"),
    "heading": ("HEADING_DEGREES", "degrees"),
    "azimuth_angle": ("AZIMUTH_DEGREES", "degrees"),
    "range_pixel_spacing": ("RANGE_PIX_METRES", "m"),
    "azimuth_pixel_spacing": ("AZIMUTH_PIX_METRES", "m"),
    "prf": ("PRF_HERTZ", "Hz"),
    "near_range_slc": ("NEAR_RANGE_METRES", "m"),
    "sar_to_earth_center": ("SAR_EARTH_METRES", "m"),
    "earth_semi_major_axis": ("SEMI_MAJOR_AXIS_METRES", "m"),
    "earth_semi_minor_axis": ("SEMI_MINOR_AXIS_METRES", "m"),
}
COUNT_FIELDS = {"range_samples": "RANGE_N", "range_looks": "RANGE_LOOKS", "azimuth_lines": "AZIMUTH_N", "azimuth_looks": "AZIMUTH_LOOKS"}
#: Our key -> how far two epochs may differ: fixed values.
TOLERANCES = {
    "INCIDENCE_DEGREES": 1e-1,
    "WAVELENGTH_METRES": 1e-6,
    "HEADING_DEGREES": 5e-1,
    "AZIMUTH_DEGREES": 1e-1,
    "RANGE_PIX_METRES": 1e-1,
    "AZIMUTH_PIX_METRES": 1e-1,
    "PRF_HERTZ": 1e-6,
    "NEAR_RANGE_METRES": 1e3,
    "SAR_EARTH_METRES": 1e3,
    "SEMI_MAJOR_AXIS_METRES": 1e-4,
    "SEMI_MINOR_AXIS_METRES": 1e-4,
}


def gamma_epoch(text: str) -> dict:
    """Header of one acquisition."""
    own = fields(text)

    def number(key: str, unit: str) -> float:
        value, *rest = own[key]
        if rest[:1] != [unit]:
            raise HeaderError(f"{key} is in {' '.join(rest) or 'no unit'}, not in {unit}")
        return float(value)

    stamp = own["date"]
    out = {"FIRST_DATE": date(*(int(float(x)) for x in stamp[:3]))}
    if len(stamp) >= 6:
        seconds = float(stamp[5])
        out["FIRST_TIME"] = f"{int(stamp[3]):02d}:{int(stamp[4]):02d}:{seconds:.10g}"
    elif "center_time" in own:
        seconds = round(float(own["center_time"][0]))
        out["FIRST_TIME"] = f"{seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"
    out["WAVELENGTH_METRES"] = SPEED_OF_LIGHT / number("radar_frequency", "Hz")
    out |= {name: number(key, unit) for key, (name, unit) in EPOCH_FIELDS.items()}
    return out | {name: int(own[key][0]) for key, name in COUNT_FIELDS.items()}


def gamma_dem(text: str) -> dict:
    """Header of a GAMMA DEM."""
    own = fields(text)
    for key in ("corner_lat", "corner_lon", "post_lat", "post_lon"):
        if own[key][1:] != ["decimal", "degrees"]:
            raise HeaderError(f"{key} is in {' '.join(own[key][1:])}, not in decimal degrees")
    return {"NCOLS": int(own["width"][0]), "NROWS": int(own["nlines"][0]), "LAT": float(own["corner_lat"][0]), "LONG": float(own["corner_lon"][0]), "Y_STEP": float(own["post_lat"][0]), "X_STEP": float(own["post_lon"][0]), "DATUM": "".join(own.get("ellipsoid_name", [])), "INSAR_PROCESSOR": "GAMMA"}


def gamma_baseline(text: str) -> dict:
    """Baseline and its rate (along, across, normal to the track): the precise
    one, or the initial one where the precise one is all zeros."""
    own = {k: [float(x) for x in v[:3]] for k, v in fields(text).items() if "baseline" in k}
    which = "precision" if any(own["precision_baseline(TCN)"]) else "initial"
    out = dict(zip(("BASELINE_T", "BASELINE_C", "BASELINE_N"), own[f"{which}_baseline(TCN)"]))
    return out | dict(zip(("BASELINE_RATE_T", "BASELINE_RATE_C", "BASELINE_RATE_N"), own[f"{which}_baseline_rate"]))


def combine(first: dict, second: dict, dem: dict, baseline: dict | None = None) -> dict:
    """Header of an interferogram from those of its two epochs, of the DEM
    and, if there is one, of its baseline. What differs too much is an error;
    the incidence is the mean, all else is the first epoch's."""
    a, b = first["FIRST_DATE"], second["FIRST_DATE"]
    if a >= b:
        raise HeaderError("the two epochs are on the same day" if a == b else "the epochs are in the wrong order")
    for key, most in TOLERANCES.items():
        if not math.isclose(first[key], second[key], rel_tol=0, abs_tol=most + 1e-5 * abs(second[key])):
            raise HeaderError(f"{key} of {a} and {b} differs by more than {most}")
    for key in COUNT_FIELDS.values():
        if first[key] != second[key]:
            raise HeaderError(f"{key} of {a} and {b} differs")
    out = {k: first[k] for k in (*TOLERANCES, *COUNT_FIELDS.values())}
    out["INCIDENCE_DEGREES"] = (first["INCIDENCE_DEGREES"] + second["INCIDENCE_DEGREES"]) / 2
    out |= {"FIRST_DATE": a, "SECOND_DATE": b, "FIRST_TIME": first.get("FIRST_TIME"), "SECOND_TIME": second.get("FIRST_TIME"), "TIME_SPAN_YEAR": (b - a).days / DAYS_PER_YEAR, "DATA_UNITS": "RADIANS", "INSAR_PROCESSOR": "GAMMA", "DATA_TYPE": "ORIGINAL_IFG"}
    return out | dem | (baseline or {})


def gamma(dem: str, epochs: list[str], baseline: str | None = None) -> dict:
    """Header of a GAMMA raster from texts: with two epochs an interferogram,
    with fewer the DEM or a raster on its grid."""
    if len(epochs) > 2:
        raise HeaderError(f"an interferogram has two epoch headers, not {len(epochs)}")
    if len(epochs) < 2:
        return gamma_dem(dem) | {"DATA_TYPE": "ORIGINAL_DEM"}
    return combine(*map(gamma_epoch, epochs), gamma_dem(dem), gamma_baseline(baseline) if baseline else None)


def header_paths(raster: str, headers: list[str]) -> list[str]:
    """Headers whose one date is among the raster's dates, in order of date."""
    dates = dates_in(raster)
    found = {d[0]: h for h in headers if len(d := dates_in(h)) >= 1 and d[0] in dates}
    return [found[d] for d in sorted(found)]


def baseline_path(raster: str, baselines: list[str]) -> str | None:
    """The baseline with the raster's two dates; more than one is an error."""
    found = [b for b in baselines if dates_in(b)[:2] == dates_in(raster)[:2]]
    if len(found) > 1:
        raise HeaderError(f"more than one baseline file for {raster}")
    return found[0] if found else None


def roipac(text: str, name: str) -> dict:
    """Header of a ROI_PAC raster; it is a DEM's if it names a datum. Dates
    come from the header, or else from the file's name."""
    try:
        own = dict(line.split() for line in text.splitlines() if line.strip())
    except ValueError:
        raise HeaderError(f"{name} is no ROI_PAC header") from None
    is_dem = any(k in own for k in ("DATUM", "Z_SCALE", "PROJECTION"))
    if is_dem and "DATUM" not in own:
        raise HeaderError(f"{name} has no DATUM")
    ncols, nrows = int(own["WIDTH"]), int(own["FILE_LENGTH"])
    x, y, dx, dy = (float(own[k]) for k in ("X_FIRST", "Y_FIRST", "X_STEP", "Y_STEP"))
    out = {"NCOLS": ncols, "NROWS": nrows, "LAT": y, "LONG": x, "X_STEP": dx, "Y_STEP": dy, "X_LAST": x + dx * ncols, "Y_LAST": y + dy * nrows, "INSAR_PROCESSOR": "ROIPAC"}
    if is_dem:
        return out | {"DATUM": own["DATUM"], "DATA_TYPE": "ORIGINAL_DEM"}
    dates = [century(d) for d in own["DATE12"].split("-")] if "DATE" in own and "DATE12" in own else dates_in(name)
    a, b = dates[:2]
    return out | {"WAVELENGTH_METRES": float(own["WAVELENGTH"]), "FIRST_DATE": a, "SECOND_DATE": b, "TIME_SPAN_YEAR": (b - a).days / DAYS_PER_YEAR, "DATA_UNITS": "RADIANS", "DATA_TYPE": "ORIGINAL_IFG"}
