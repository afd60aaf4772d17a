"""ISO codes and presets. Country codes come from the Java runtime's list; subdivisions of further countries can be registered."""

from __future__ import annotations

from functools import lru_cache

from tabloom.errors import ConfigError

# ISO 3166-2 local codes.
SUBDIVISIONS: dict[str, list[str]] = {
    "US": (
        "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK "
        "OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC AS GU MP PR UM VI"
    ).split(),
    "CA": "AB BC MB NB NL NS NT NU ON PE QC SK YT".split(),
    "AU": "ACT NSW NT QLD SA TAS VIC WA".split(),
    "DE": "BB BE BW BY HB HE HH MV NI NW RP SH SL SN ST TH".split(),
    "BR": "AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split(),
}

#: Preset names and the country whose subdivisions they are.
PRESETS = {"us_states": "US", "ca_provinces": "CA"}


def register_subdivisions(country: str, codes: list[str]) -> None:
    """Adds or replaces a country's local codes (of which ISO 3166-2 has thousands, so they aren't all here)."""
    SUBDIVISIONS[country.upper()] = [c.upper() for c in codes]


def subdivisions(country: str) -> list[str]:
    return SUBDIVISIONS.get(country.upper(), [])


def resolve_preset(name: str) -> list[str]:
    if name not in PRESETS:
        raise ConfigError(f"unknown preset {name!r}: one of {', '.join(PRESETS)} is needed")
    return sorted(SUBDIVISIONS[PRESETS[name]])


@lru_cache(maxsize=1)
def countries() -> list[str]:
    """The ISO 3166-1 alpha-2 codes (249), without the one withdrawn code that the Java list keeps."""
    from pyspark import SparkContext

    return sorted(set(SparkContext.getOrCreate()._jvm.java.util.Locale.getISOCountries()) - {"AN"})
