"""Spectral indices as column expressions, in a plain and in a guarded family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
#: The band of each role, by sensor.
BANDS = {
    "fused_satellite": {"red": "Drag_660nm", "nir": "S2_B8_842nm", "nir_narrow": "S2_B8A_865nm", "swir1": "S2_B11_1614nm", "swir2": "S2_B12_2202nm", "green": "Drag_549nm", "blue": "Drag_503nm"},
    "maxar": {"coastal": "Maxar_Coastal_425nm", "blue": "Maxar_Blue_480nm", "green": "Maxar_Green_545nm", "yellow": "Maxar_Yellow_605nm", "red": "Maxar_Red_660nm", "rededge": "Maxar_RedEdge_725nm", "nir": "Maxar_NIR1_832nm", "nir_narrow": "Maxar_NIR2_950nm"},
    "fused_spot_s2": {"red": "S2_B4_red", "nir": "S2_B8_nir", "nir_narrow": "S2_B8A_nir08", "swir1": "S2_B11_swir16", "swir2": "S2_B12_swir22", "green": "S2_B3_green", "blue": "S2_B2_blue"},
}


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def plain_indices(band: dict[str, Column]) -> dict[str, Column]:
    """Indices that add a small constant to the denominator; short-wave ones only where their bands are given."""
    red, nir = band["red"], band["nir"]
    out = {"NDVI": _ratio(nir - red, nir + red + EPS), "SAVI": 1.5 * _ratio(nir - red, nir + red + 0.5)}
    if {"swir1", "swir2", "blue"} <= band.keys():
        s1, s2, blue = band["swir1"], band["swir2"], band["blue"]
        out["BSI"] = _ratio((s1 + red) - (nir + blue), (s1 + red) + (nir + blue) + EPS)
        out["NDMI"] = _ratio(nir - s1, nir + s1 + EPS)
        out["Clay_Index"] = _ratio(s2, s1 + EPS)
        if "green" in band:
            green = band["green"]
            out["NDWI"] = _ratio(green - nir, green + nir + EPS)
            out["Calcite_Index"] = _ratio(s1 - s2, s1 + s2 + EPS)
    return out


def _guarded(a: Column, b: Column, ok: Column) -> Column:
    return F.when(ok, _ratio(a, b)).otherwise(F.lit(0.0))


def guarded_indices(band: dict[str, Column]) -> dict[str, Column]:
    """Indices that are zero where their denominator is not usable."""
    red, nir, out = band["red"], band["nir"], {}
    out["NDVI"] = _guarded(nir - red, nir + red + EPS, nir + red > 0)
    if "rededge" in band:
        edge = band["rededge"]
        out["RE_NDVI"] = _guarded(nir - edge, nir + edge + EPS, nir + edge > 0)
    if "blue" in band:
        blue = band["blue"]
        out["Blue_Red"] = _guarded(blue, red, red > 0)
        out["Blue_NIR"] = _guarded(blue, nir, nir > 0)
        if "swir1" in band:
            s1 = band["swir1"]
            whole = (s1 + red) + (nir + blue)
            out["BSI"] = _guarded((s1 + red) - (nir + blue), whole, whole != 0)
    out["SAVI"] = 1.5 * _ratio(nir - red, nir + red + 0.5)
    root = F.sqrt(F.greatest((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red), F.lit(0.0)))
    out["MSAVI"] = (2 * nir + 1 - root) / 2
    return out


def sensor_bands(sensor: str) -> dict[str, str] | None:
    """The band table of a sensor: by its name, else by a table's name that it begins with."""
    return BANDS.get(sensor) or next((v for k, v in BANDS.items() if sensor.startswith(k)), None)


def with_indices(df: DataFrame, sensor: str) -> DataFrame:
    """``df`` with the plain indices of a sensor, or as it is if the sensor is unknown or lacks any band."""
    bands = sensor_bands(sensor)
    if bands is None or any(b not in df.columns for b in bands.values()):
        return df
    return df.withColumns(plain_indices({role: F.col(b).cast("double") for role, b in bands.items()}))


def prefixed(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({n: prefix + n for n in names})
