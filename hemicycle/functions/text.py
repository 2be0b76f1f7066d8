"""Name and code normalisation as Spark columns."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, functions as F

_BLANK = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# fixed values: spellings of communes in result files and their map name
COMMUNE_ALIASES = {
    "MARCHIGUE": "MARCHIHUE",
    "TREHUACO": "TREGUACO",
    "PAIHUANO": "PAIGUANO",
    "LLAY-LLAY": "LLAILLAY",
    "CABO DE HORNOS(EX-NAVARINO)": "CABO DE HORNOS",
}


@functools.cache
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form has one ASCII letter, or several."""
    single, several = {}, {}
    for code in range(0x80, 0x1FBFA):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[char] = plain
        elif plain:
            several[char] = plain
    return "".join(single), "".join(single.values()), several


def strip(value: Column) -> Column:
    return F.regexp_replace(value, _BLANK, "")


def to_ascii(value: Column) -> Column:
    """Compatibility decomposition, then everything outside ASCII dropped.

    One-letter forms go through ``translate``; only texts that hold one of the
    rarer several-letter forms are spelled out character by character. Pure
    ASCII (as many bytes as characters) is returned as it is.
    """
    source, target, several = _ascii_tables()
    plain = F.translate(value, source, target)
    pairs = "\x02".join(f"{c}\x01{spelling}" for c, spelling in several.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))
    spelled = F.array_join(
        F.transform(
            F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)),
            lambda c: F.coalesce(F.element_at(table, c), c),
        ),
        "",
    )
    rare = F.length(F.translate(plain, "".join(several), "")) < F.length(plain)
    full = F.when(rare, spelled).otherwise(plain)
    is_ascii = F.length(value) == F.octet_length(value)
    return F.when(is_ascii, value).otherwise(F.regexp_replace(full, r"[^\x00-\x7F]", ""))


def normalize_cut(value: Column) -> Column:
    """``1101``, ``"1101"`` and ``1101.0`` all become ``"01101"``; text fails."""
    number = value.cast("string").cast("double").cast("long").cast("string")
    return F.when(F.length(number) >= 5, number).otherwise(F.lpad(number, 5, "0"))


def normalize_party_name(value: Column) -> Column:
    return strip(to_ascii(F.lower(value)))


def normalize_commune_name(value: Column) -> Column:
    return F.coalesce(F.upper(strip(to_ascii(value))), F.lit(""))


def resolve_commune_alias(value: Column) -> Column:
    name = normalize_commune_name(value)
    table = F.create_map(*[F.lit(x) for pair in COMMUNE_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, name), name)


def parse_district_id(value: Column) -> Column:
    """First run of digits as a number, null when there is none."""
    digits = F.regexp_extract(value.cast("string"), r"\d+", 0)
    return F.nullif(digits, F.lit("")).try_cast("int")


def independent_to_party(value: Column) -> Column:
    named = F.regexp_replace(strip(value), r"(?i)^INDEPENDIENTE\s+(.+)$", "PARTIDO $1")
    return normalize_party_name(named)


def candidate_full_name(names: Column, first: Column, second: Column) -> Column:
    parts = F.concat(F.coalesce(names, F.lit("")), F.lit(" "), F.coalesce(first, F.lit("")),
                     F.lit(" "), F.coalesce(second, F.lit("")))
    return F.trim(F.regexp_replace(parts, r"\s+", " "))


def standard_ids(cut: Column, district: Column) -> dict[str, Column]:
    """Region and province codes and the census district id of a unit."""
    code = normalize_cut(cut)
    return {
        "region": F.substring(code, 1, 2).cast("int"),
        "province": F.substring(code, 1, 3).cast("int"),
        "unit_id": F.concat_ws("_", code, F.lpad(district.cast("int").cast("string"), 3, "0")),
    }
