"""Scalar functions as column expressions: names and their tags, codes, times and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the naming convention: each region with the language of its releases where no tag says.
REGION_LANGUAGE = {
    "World": "EN",
    "USA": "EN",
    "Europe": "EN",
    "Japan": "JA",
    "Australia": "EN",
    "Canada": "EN",
    "UK": "EN",
    "Ireland": "EN",
    "Germany": "DE",
    "France": "FR",
    "Spain": "ES",
    "Italy": "IT",
    "Netherlands": "NL",
    "Sweden": "SV",
    "Norway": "NO",
    "Denmark": "DA",
    "Finland": "FI",
    "Portugal": "PT",
    "Brazil": "PT",
    "Mexico": "ES",
    "Korea": "KO",
    "China": "ZH",
    "Taiwan": "ZH",
    "Hong Kong": "ZH",
    "Russia": "RU",
    "Poland": "PL",
    "Greece": "EL",
    "Asia": "EN",
}
#: Fixed values of the naming convention: languages that a tag may list.
LANGUAGES = "En Ja Fr De Es It Nl Pt Sv No Da Fi Zh Ko Pl Ru El Cs Hu Ca Gd Tr".split()


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _looked_up(tag: Column, known: dict[str, str]) -> Column:
    """The parts of a tag, between commas, as known in lower case; an empty array unless all are known."""
    parts = F.filter(F.transform(F.split(tag, ","), lambda p: F.try_element_at(_map(known), F.lower(F.trim(p)))), lambda p: p.isNotNull())
    given = F.filter(F.transform(F.split(tag, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) == F.size(given), parts).otherwise(F.array().cast("array<string>"))


def alnum(c: Column) -> Column:
    """Upper-case letters and digits of a text, all else left out."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def tags(name: Column) -> Column:
    """Contents of the parentheses of a name, in order."""
    return F.regexp_extract_all(name, F.lit(r"\(([^()]*)\)"), F.lit(1))


def parsed_name(name: Column) -> Column:
    """title, regions, languages, revision, disc, prerelease and unlicensed of a release's name, by its tags; case doesn't matter.

    A tag whose parts, between commas, are all regions adds these, and so do languages. Rev takes a number, or a letter as its place in the
    alphabet, or anything else as 1; v1.2 is revision 12 (tenths, halves to even), and one that is no number is 0. Of several revisions or discs the last
    holds; a disc with more in its tag (of 2) is none. Without a language tag there are no languages (see default_language). The title is the
    name without tags, trimmed, each run of blanks one.
    """
    t = F.filter(F.transform(tags(name), lambda x: F.trim(x)), lambda x: x != "")
    all_of = lambda known: F.flatten(F.transform(t, lambda x: _looked_up(x, known)))
    last = lambda pattern, value: F.coalesce(F.try_element_at(F.filter(F.transform(F.filter(t, lambda x: x.rlike(pattern)), value), lambda x: x.isNotNull()), F.lit(-1)), F.lit(0))
    rev = r"(?i)^(?:Rev\s+([0-9A-Za-z]+)|v([0-9][0-9.]*))$"

    def revision(x: Column) -> Column:
        r, v = F.regexp_extract(x, rev, 1), F.regexp_extract(x, rev, 2)
        lettered = F.when(F.length(r) == 1, F.ascii(F.upper(r)) - 64).otherwise(1)
        return F.when(r != "", F.coalesce(r.try_cast("int"), lettered)).otherwise(F.coalesce(F.bround(v.try_cast("double") * 10).cast("int"), F.lit(0)))

    some = lambda pattern: F.exists(t, lambda x: x.rlike(pattern))
    return F.struct(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\([^()]*\)", ""), r"^\s+|\s+$", ""), r"\s{2,}", " ").alias("title"),
        all_of({r.lower(): r for r in REGION_LANGUAGE}).alias("regions"),
        all_of({x.lower(): x.upper() for x in LANGUAGES}).alias("languages"),
        last(rev, revision).cast("int").alias("revision"),
        last(r"(?i)^Disc\s+\d+$", lambda x: F.regexp_extract(x, r"(\d+)$", 1).try_cast("int")).cast("int").alias("disc"),
        some("(?i)^(?:beta|proto|demo|sample|alpha|preview)").alias("prerelease"),
        some("(?i)^unl|aftermarket|pirate").alias("unlicensed"),
    )


def default_language(region: Column) -> Column:
    """The language of a region's releases, EN for one that isn't known."""
    return F.coalesce(F.try_element_at(_map({k.lower(): v for k, v in REGION_LANGUAGE.items()}), F.lower(region)), F.lit("EN"))


def tagged_name(name: Column) -> Column:
    """A stricter reading of the same tags: title before the first parenthesis, the first region tag only, languages if a tag has two or more, disc of how many, the version as written, and flags."""
    t = tags(name)
    parts = lambda x: F.transform(F.split(x, "[,+]"), lambda p: F.trim(p))
    known = F.array(*map(F.lit, REGION_LANGUAGE))
    region = F.get(F.filter(t, lambda x: F.exists(parts(x), lambda p: F.array_contains(known, p))), F.lit(0))
    languages = F.get(F.filter(t, lambda x: (F.size(parts(x)) >= 2) & F.forall(parts(x), lambda p: p.rlike("^[A-Z][a-z]$"))), F.lit(0))
    first = lambda pattern, g=1: F.get(F.filter(F.transform(t, lambda x: F.regexp_extract(x, pattern, g)), lambda x: x != ""), F.lit(0))
    flag = lambda pattern: F.exists(t, lambda x: x.rlike(pattern))
    return F.struct(
        F.trim(F.substring_index(name, "(", 1)).alias("title"),
        region.alias("region"),
        languages.alias("languages"),
        first(r"^Dis[ck] ([0-9]+)").try_cast("int").alias("disc"),
        first(r"^Dis[ck] [0-9]+ of ([0-9]+)$").try_cast("int").alias("discs"),
        first(r"^(v[0-9].*)$").alias("version"),
        flag("^Demo|^Kiosk").alias("is_demo"),
        flag("^Beta").alias("is_beta"),
        flag("^Proto").alias("is_proto"),
        flag("^Sample").alias("is_sample"),
        flag("^Unl$").alias("is_unlicensed"),
        flag("^Alt").alias("is_alternative"),
    )


def csv_cell(c: Column) -> Column:
    """A cell, quoted only where it has a comma, a quote or a line's end."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def leaf(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def stem(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(leaf(path), r"(.)\.[^.]*$", "$1")


def safe_name(c: Column) -> Column:
    """A name without characters that file systems refuse, nor dots or blanks at its end; _ if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.when(out == "", "_").otherwise(out)


def valid_mcn(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{13}$"), F.lit(False))


def valid_isrc(c: Column) -> Column:
    return F.coalesce(F.upper(F.replace(c, F.lit("-"), F.lit(""))).rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), F.lit(False))


def sid_code(c: Column) -> Column:
    """IFPI code of a mould or mastering mark: L and three digits or letters, or four of them; null if there's none."""
    out = F.regexp_extract(F.upper(c), r"IFPI\s*(L[A-Z0-9]{3}|[A-Z0-9]{4})\b", 1)
    return F.nullif(out, F.lit(""))


def msf_sectors(c: Column) -> Column:
    """Sectors of minute:second:frame, at 75 a second; null if it isn't one."""
    m = lambda k: F.regexp_extract(c, r"^(\d+):([0-5]\d):([0-6]\d|7[0-4])$", k).try_cast("long")
    return (m(1) * 60 + m(2)) * 75 + m(3)


def sectors_msf(c: Column) -> Column:
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(c / 4500)
    return F.concat_ws(":", F.when(minutes < 100, part(minutes)).otherwise(minutes.cast("string")), part(F.floor(c / 75) % 60), part(c % 75))


def bcd(c: Column) -> Column:
    """The number that a byte holds in binary-coded decimal; null above 9 in either half."""
    hi, lo = F.floor(c / 16), c % 16
    return F.when((hi < 10) & (lo < 10), hi * 10 + lo)


def volume_date(c: Column) -> Column:
    """A UTC time from the 16 digits YYYYMMDDhhmmsscc and an offset of quarter hours after a blank; null if blank, zero or not a date."""
    d = F.regexp_extract(c, r"^(\d{16})", 1)
    at = F.try_to_timestamp(F.substring(d, 1, 14), F.lit("yyyyMMddHHmmss"))
    quarters = F.coalesce(F.regexp_extract(c, r" (-?\d+)$", 1).try_cast("int"), F.lit(0))
    return F.when((d != "") & (F.substring(d, 1, 4) != "0000"), at - F.make_dt_interval(mins=quarters * 15))


def digest_of(*parts: Column) -> Column:
    """SHA-256 of texts joined by line feeds; null parts are empty."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def arrhenius(celsius: Column, reference: float = 25.0, energy_ev: float = 0.7) -> Column:
    """How much faster a reaction of this activation energy runs than at the reference temperature."""
    boltzmann = 8.617333262e-5
    return F.exp(F.lit(energy_ev / boltzmann) * (F.lit(1 / (reference + 273.15)) - 1 / (celsius + 273.15)))


#: Endings of files that a build for debugging leaves, and what folders or files of one have in their names.
DEBUG_ENDINGS = (".sym", ".map", ".pdb", ".cvd", ".ndb", ".dbg", ".elf.map")
DEBUG_NAMES = ("debug", "devkit", "dev-kit", "internal", "proto", "prototype", "qa", "_build", "sandbox")


def residue(path: Column) -> Column:
    """Kinds of development residue in a path, without its version (;1) and whatever its case: a file by its ending, a folder or file by what its name has in it; none, one or both."""
    low = F.trim(F.lower(F.translate(F.substring_index(path, ";", 1), "\\", "/")))
    ends = [F.endswith(low, F.lit(e)) for e in DEBUG_ENDINGS]
    names = low.rlike("|".join(DEBUG_NAMES))
    return F.array_compact(F.array(F.when(_any(ends), "file"), F.when(names, "name")))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def rebuild_path(layout: str, system: Column, game: Column, name: Column) -> Column:
    """Where a matched file goes: flat, by game, or by system and game."""
    parts = {"flat": [name], "game": [game, name], "system": [system, game, name]}[layout]
    return F.concat_ws("/", *(safe_name(p) for p in parts))


def places(content: Column, needle: bytes) -> Column:
    """Places, from 0, of all occurrences of a needle in binary content, overlapping ones too."""
    n = len(needle)
    starts = F.when(F.octet_length(content) >= n, F.sequence(F.lit(0), F.octet_length(content) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(content, i + 1, F.lit(n)) == F.lit(needle)) if n else F.array().cast("array<int>")


def layout_hash(tracks: Column) -> Column:
    """SHA-256 of a layout, an array of tracks (number, is_data, units): their number, then each in order with its kind and length."""
    ordered = F.array_sort(F.transform(tracks, lambda t: F.struct(t["number"].alias("number"), t["is_data"].alias("is_data"), t["units"].alias("units"))))
    each = F.transform(ordered, lambda t: F.concat(t["number"].cast("string"), F.when(t["is_data"], "D").otherwise("A"), t["units"].cast("string"), F.lit(";")))
    return F.sha2(F.concat(F.size(tracks).cast("string"), F.lit(";"), F.array_join(each, "")), 256)


def best_shift(a: Column, b: Column, most: int = 4, tolerance: int = 1) -> Column:
    """shift and share: the shift of at most so many places under which two envelopes agree best, within the tolerance, and the share of the places that overlap which do; the first of equals, 1 for two empty ones."""

    def at(d: Column) -> Column:
        pairs = F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), F.when(i + d >= 0, F.get(b, i + d)).alias("y"))), lambda p: p["y"].isNotNull())
        return F.struct(F.coalesce(F.size(F.filter(pairs, lambda p: F.abs(p["x"] - p["y"]) <= tolerance)) / F.nullif(F.size(pairs), F.lit(0)), F.lit(0.0)).alias("share"), (-d).alias("back"))

    best = F.array_max(F.transform(F.sequence(F.lit(-most), F.lit(most)), at))
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.struct(F.when(none | (best["share"] == 0), 0).otherwise(-best["back"]).alias("shift"), F.when(none, 1.0).otherwise(best["share"]).alias("share"))
