"""Scalar functions: each takes and returns columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- text -------------------------------------------------------------------------


def clean_text(text: Column | str) -> Column:
    """White space collapsed and trimmed; blank text is NULL."""
    return F.nullif(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), F.lit(""))


def fold_key(text: Column | str, joiner: str = "") -> Column:
    """Lower-case letters and digits without accents; runs of anything else become joiner (slug: "-")."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    flat = F.translate(F.lower(clean_text(text)), accents, plain)
    out = F.regexp_replace(flat, "[^a-z0-9]+", joiner)
    return F.regexp_replace(out, f"^{joiner}+|{joiner}+$", "") if joiner else out


#: Tokens that mean blank.
BLANK_TOKENS = ("nan", "na", "n a", "nil", "none", "not issued")


def is_blank_token(text: Column | str) -> Column:
    key = F.trim(F.regexp_replace(F.lower(clean_text(text)), "[^a-z0-9]+", " "))
    return clean_text(text).isNull() | key.isin(*BLANK_TOKENS) | clean_text(text).isin("-", "--")


def normalise_alias(text: Column | str, aliases: Mapping[str, str]) -> Column:
    """The alias table's spelling, else title case; blank tokens become the empty text."""
    key = F.trim(F.regexp_replace(F.lower(clean_text(text)), "[^a-z0-9]+", " "))
    found = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[key] if aliases else F.lit(None).cast("string")
    return F.coalesce(found, F.when(is_blank_token(text), F.lit("")).otherwise(F.initcap(clean_text(text))))


def multi_pattern_tags(text: Column | str, patterns: Mapping[str, Sequence[str]]) -> Column:
    """Labels with a matching pattern, in the order of the table."""
    return F.array_compact(F.array(*[F.when(F.coalesce(_c(text), F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in own)), F.lit(label)) for label, own in patterns.items()]))


def substring_tags(text: Column | str, table: Mapping[str, str]) -> Column:
    """Distinct values of the keys that the text contains."""
    low = F.lower(F.coalesce(clean_text(text), F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in table.items()])))


def extract_code(explicit: Column | str, text: Column | str, pattern: str) -> tuple[Column, Column]:
    """(code, basis): the explicit code, else the first match in the text."""
    found = F.nullif(F.regexp_extract(F.upper(_c(text)), pattern, 0), F.lit(""))
    code = F.when(~is_blank_token(explicit), clean_text(explicit)).otherwise(found)
    basis = F.when(~is_blank_token(explicit), "explicit").when(found.isNotNull(), "parsed_from_text")
    return code, basis


def extract_area(explicit: Column | str, text: Column | str) -> tuple[Column, Column]:
    """(area, basis): a number in the explicit field, else a number with a hectare unit in the text."""
    direct = F.nullif(F.regexp_extract(F.regexp_replace(_c(explicit), ",", ""), r"\d+(\.\d+)?", 0), F.lit("")).try_cast("double")
    parsed = F.nullif(F.regexp_extract(_c(text), r"(?i)(\d+(\.\d+)?)\s*(ha\.?|hectares?\b|hects?\b|hc\.?)", 1), F.lit("")).try_cast("double")
    blank = is_blank_token(explicit)
    return F.when(~blank & direct.isNotNull(), direct).otherwise(parsed), F.when(~blank & direct.isNotNull(), "explicit").when(parsed.isNotNull(), "parsed_from_text")


def parse_dirty_date(text: Column | str) -> Column:
    """Day-first date out of one with ordinals and day-part notes; several dates or prose give NULL."""
    raw = clean_text(text)
    several = raw.rlike(r"(?i)\b\d{1,2}(st|nd|rd|th)?\s*(&|and)\s*\d{1,2}")
    flat = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"(?i)\((an|fn)\)", ""))
    numeric = F.regexp_extract(flat, r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})$", 0)
    day = lambda i: F.regexp_extract(flat, r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})$", i)
    dotted = F.when(numeric != "", F.try_to_date(F.concat_ws("-", day(1), day(2), day(3)), "d-M-yyyy"))
    worded = F.coalesce(F.try_to_date(flat, "d MMMM yyyy"), F.try_to_date(flat, "d MMM yyyy"), F.try_to_date(flat, "yyyy-MM-dd"))
    return F.when(is_blank_token(text) | several, F.lit(None).cast("date")).otherwise(F.coalesce(dotted, worded))


def in_fiscal_year(date: Column | str, fiscal_year: Column | str) -> Column:
    """Does the date lie in April to March of the year 'YYYY-YY'? NULL without a date."""
    first = F.substring(_c(fiscal_year), 1, 4).cast("int")
    return _c(date).between(F.make_date(first, F.lit(4), F.lit(1)), F.make_date(first + 1, F.lit(3), F.lit(31)))


def date_from_year_doy(year: Column | str, doy: Column | str) -> Column:
    return F.date_add(F.make_date(_c(year), F.lit(1), F.lit(1)), _c(doy).cast("int") - 1)


def dms_to_decimal(text: Column | str) -> Column:
    """'24 16 30 N' style degrees, minutes and seconds with a hemisphere; NULL for anything else."""
    pattern = r"(?i)^\s*(\d{1,3})[^\d]+(\d{1,2})[^\d]+(\d{1,2}(?:\.\d+)?)[^\dNSEW]*([NSEW])\s*$"
    part = lambda i: F.regexp_extract(_c(text), pattern, i)
    value = part(1).try_cast("double") + part(2).try_cast("double") / 60 + part(3).try_cast("double") / 3600
    return F.when(part(4) != "", F.when(F.upper(part(4)).isin("S", "W"), -value).otherwise(value))


def _component(parts: Column) -> Column:
    return F.get(parts, F.lit(0)) + F.coalesce(F.get(parts, F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get(parts, F.lit(2)), F.lit(0.0)) / 3600


def parse_coordinate_range(text: Column | str, axis: str) -> Column:
    """struct(lower, upper, odd): a point or range of degree parts; the right end inherits missing leading parts. NULL if malformed."""
    raw = F.regexp_replace(F.upper(F.trim(_c(text))), "°", " ")
    letters = F.regexp_extract_all(raw, F.lit("([NSEW])"), F.lit(1))
    hemisphere = F.try_element_at(letters, F.lit(-1))
    right_axis = hemisphere.isin("N", "S") if axis == "latitude" else hemisphere.isin("E", "W")
    body = F.regexp_replace(raw, "[NSEW]", "")
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda v: v.cast("double"))
    cut = F.split(body, "-", 2)
    left, right = numbers(F.get(cut, F.lit(0))), numbers(F.coalesce(F.get(cut, F.lit(1)), F.lit("")))
    given = F.concat(F.slice(left, F.lit(1), F.greatest(F.size(left) - F.size(right), F.lit(0))), right)
    ranged = F.size(cut) == 2
    four = ~ranged & (F.size(left) == 4) & (F.get(left, F.lit(0)) == F.get(left, F.lit(2)))
    ends = (
        F.when(ranged & F.size(left).between(1, 3) & F.size(right).between(1, 3), F.array(_component(left), _component(given)))
        .when(~ranged & F.size(left).between(1, 3), F.array(_component(left), _component(left)))
        .when(four, F.array(_component(F.slice(left, 1, 2)), _component(F.slice(left, 3, 2))))
    )
    sign = F.when(hemisphere.isin("S", "W"), -1.0).otherwise(1.0)
    signed = F.transform(ends, lambda v: v * sign)
    limit = 90.0 if axis == "latitude" else 180.0
    fits = (F.size(letters) > 0) & right_axis & (F.array_min(signed) >= -limit) & (F.array_max(signed) <= limit)
    return F.when(fits, F.struct(F.array_min(signed).alias("lower"), F.array_max(signed).alias("upper"), four.alias("odd")))


def text_between(text: Column | str, start: str, ends: Sequence[str], limit: int) -> Column:
    """Text behind the first start marker up to the nearest end marker, at most limit characters; NULL without the start."""
    at = F.instr(_c(text), start)
    rest = F.substring(_c(text), at + len(start), F.length(_c(text)))
    stops = [F.when(F.instr(rest, e) > 0, F.instr(rest, e) - 1) for e in ends]
    stop = F.coalesce(F.least(*stops) if len(stops) > 1 else stops[0], F.length(rest))
    return F.when(at > 0, F.substring(rest, F.lit(1), F.least(stop, F.lit(limit))))


def plain_words(x: Column | str) -> Column:
    """Lower-case letters and digits, anything else as one space; empty for NULL."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+", " "))


def term_found(term: Column | str, text: Column | str, suffixes: Sequence[str] = (), alternatives: Mapping[str, str] | None = None) -> Column:
    """Is the term in the text: as it is, without spaces (six characters or more), without a trailing suffix (four or more), or by another spelling?"""
    needle, hay = plain_words(term), plain_words(text)
    compact = F.replace(needle, F.lit(" "), F.lit(""))
    found = F.contains(hay, needle) | ((F.length(compact) >= 6) & F.contains(F.replace(hay, F.lit(" "), F.lit("")), compact))
    for s in suffixes:
        short = F.regexp_replace(needle, f" {s}$", "")
        found = found | (needle.endswith(" " + s) & (F.length(short) >= 4) & F.contains(hay, short))
    for name, other in (alternatives or {}).items():
        found = found | ((needle == name) & F.contains(hay, F.lit(other)))
    return found


# --- numbers ------------------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def distance_decay(km: Column | str, scale_km: float = 100.0) -> Column:
    return F.exp(-_c(km) / scale_km)


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def support_weight(n: Column | str, full: int = 20) -> Column:
    return 0.4 + 0.6 * F.least(F.lit(1.0), F.log1p(_c(n)) / F.log1p(F.lit(full)))


def normalized_difference(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0) & (a + b > 1e-6), (a - b) / (a + b))


def bare_soil_index(blue: Column, red: Column, nir: Column, swir: Column) -> Column:
    total = (swir + red) + (nir + blue)
    return F.when((blue > 0) & (red > 0) & (nir > 0) & (swir > 0) & (total > 1e-6), ((swir + red) - (nir + blue)) / total)


def positive_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 1e-6), a / b)


def safe_share(num: Column | str, den: Column | str) -> Column:
    """NULL for a zero or missing denominator."""
    return F.try_divide(_c(num), F.nullif(_c(den), F.lit(0)))


def signal_to_error(signal: Column, error: Column) -> Column:
    return F.when(error > 0, F.abs(signal) / error)


def pct_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), b) * 100


def null_sentinels(value: Column, low: float | None = None, high: float | None = None, nodata: float | None = None) -> Column:
    """NULL for values at or beyond the sentinel limits, or within 1e-6 of the nodata value."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value <= low)
    if high is not None:
        bad = bad | (value >= high)
    if nodata is not None:
        bad = bad | (F.abs(value - nodata) <= 1e-6)
    return F.when(~bad & ~F.isnan(value), value)


# --- keys and nested values ------------------------------------------------------------


def json_profile(*columns: Column) -> Column:
    """Compact JSON with explicit nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def json_array_parse(text: Column | str, of: str = "string") -> Column:
    """JSON list as array; bad JSON and NULL give an empty array."""
    return F.coalesce(F.from_json(_c(text), f"array<{of}>"), F.array().cast(f"array<{of}>"))


def stable_id(prefix: str, *columns: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256), 1, length))


def row_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns])), 256)


def identity_key(code: Column | str, *parts: Column | str) -> tuple[Column, Column]:
    """(key, method): the code if there is one, else the folded parts."""
    has = ~is_blank_token(code)
    return F.when(has, F.concat(F.lit("code:"), F.upper(clean_text(code)))).otherwise(F.concat(F.lit("name:"), F.concat_ws("|", *[F.coalesce(fold_key(p), F.lit("")) for p in parts]))), F.when(has, "code").otherwise("normalised_composite")


def lineage_key(name: Column | str, spellings: Mapping[str, str], cut_at: Sequence[str], stop_words: Sequence[str]) -> Column:
    """Lower case, spelling fixes, cut at the first of the given words, stop words dropped, slug."""
    out = F.replace(F.lower(_c(name)), F.lit("&"), F.lit(" and "))
    for wrong, right in spellings.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    if cut_at:
        out = F.regexp_replace(out, r"\b(" + "|".join(cut_at) + r")\b.*$", "")
    if stop_words:
        out = F.regexp_replace(out, r"\b(" + "|".join(stop_words) + r")\b", " ")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def parameter_semantics(symbol: Column | str, oxides: Sequence[str], special: Sequence[str]) -> tuple[Column, Column]:
    """(class, element symbols): oxide, isotope ratio or value, trace element, or other."""
    s = _c(symbol)
    kind = (
        F.when(s.isin(*oxides), "major_oxide")
        .when(s.isin(*special), F.when(s.contains("/"), "isotope_ratio").otherwise("calculated_isotope_value"))
        .when(s == "F", "element")
        .when(s.rlike("^[A-Z][a-z]?$"), "trace_element")
        .otherwise("chemical_parameter")
    )
    return kind, F.array_distinct(F.regexp_extract_all(s, F.lit("([A-Z][a-z]?)"), F.lit(1)))


def to_number(text: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(text)), ",", "").try_cast("double")


def pad_code(text: Column | str, width: int) -> Column:
    return F.lpad(F.trim(_c(text)), width, "0")


def concat_fields(*columns: Column | str) -> Column:
    return F.concat_ws(" ", *columns)


# --- classes ------------------------------------------------------------------------------


#: Fixed values in the next two functions: the limits and labels of the terrain and weather classes.
def classify_terrain(elevation: Column | str, slope: Column | str) -> Column:
    """The last matching override wins, so they stand in reverse order."""
    e, s = _c(elevation), _c(slope)
    return F.when(e.isNull(), "unavailable").when(e >= 3000, "high_mountain_or_alpine").when(s >= 15, "steep_mountainous").when(s >= 5, "hilly").when(e < 50, "coastal_or_lowland").otherwise("plateau_or_plain")


def classify_weather(temperature: Column | str, precipitation: Column | str) -> Column:
    t, p = _c(temperature), _c(precipitation)
    return (
        F.when(t.isNull() | p.isNull(), "unavailable")
        .when(t < 10, "cold_or_highland")
        .when((t >= 24) & (p < 500), "hot_arid_or_semiarid")
        .when((t >= 24) & (p >= 1500), "hot_humid")
        .when((t >= 20) & (p >= 800), "warm_monsoonal")
        .when(p < 500, "temperate_semiarid")
        .otherwise("temperate_monsoonal")
    )


def classify_texture(sand: Column, silt: Column, clay: Column) -> Column:
    """Soil texture class (USDA triangle, Soil Survey Manual) of shares normalised to 100; NULL without a positive total.

    The triangle is cut into bands of clay, and each band is divided by sand and silt, so regions need no order among bands. Fixed values: the triangle's
    limits in percent.
    """
    total = sand + silt + clay
    s, i, c = 100 * sand / total, 100 * silt / total, 100 * clay / total
    clayey = F.when(i > 40, "silty clay").when(s > 45, "sandy clay").otherwise("clay")
    between = F.when(s > 45, F.when(c >= 35, "sandy clay").otherwise("sandy clay loam")).when(s > 20, "clay loam").otherwise("silty clay loam")
    middle = F.when(i >= 50, "silt loam").when((s > 45) & (i < 28), "sandy clay loam").otherwise("loam")
    silty = F.when((i >= 80) & (c < 12), "silt").otherwise("silt loam")
    coarse = F.when(i + 1.5 * c < 15, "sand").when(i + 2 * c < 30, "loamy sand").when((c >= 7) & (i >= 28) & (s <= 52), "loam").otherwise("sandy loam")
    light = F.when(i >= 50, silty).otherwise(coarse)
    return F.when(total > 0, F.when(c >= 40, clayey).when(c >= 27, between).when(c >= 20, middle).otherwise(light))


def classify_record(status: Column | str, classes: Mapping[str, Sequence[str]], default: str) -> Column:
    out = None
    for label, values in classes.items():
        out = (F.when if out is None else out.when)(_c(status).isin(*values), label)
    return out.otherwise(default)


def classify_support(dry: Column | str, post: Column | str, annual: Column | str) -> Column:
    return F.when((_c(dry) >= 5) & (_c(post) >= 5), "two_season_support").when(_c(annual) >= 10, "one_season_dominant_support").otherwise("insufficient_support")


def quality_flags(rules: Mapping[str, Column]) -> Column:
    """Names of the predicates that hold, in order; a NULL predicate does not hold."""
    return F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in rules.items()]))


def promote(known_km: Column, km: Column, support: Column, percentile: Column, score: Column, auc: Column, recall: Column) -> tuple[Column, Column]:
    """(record class, validation tier) from distance, support, percentile, score and holdout gates."""
    fits = (km > 25) & (km <= 250) & (support >= 10)
    strong = (auc >= 0.75) & (recall >= 0.20)
    record = (
        F.when(known_km <= 5, "known_evidence_area")
        .when(fits & strong & (percentile >= 0.999) & (score >= 0.55), "high_priority_candidate")
        .when(fits & (auc >= 0.60) & (percentile >= 0.995) & (score >= 0.50), "priority_candidate")
        .otherwise("regional_background")
    )
    tier = F.when(strong, "strong_holdout").when(auc >= 0.60, "passes_minimum_holdout").when(auc.isNotNull(), "fails_minimum_holdout").otherwise("not_spatially_validated")
    return record, tier


def numeric_or_token(text: Column | str) -> tuple[Column, Column]:
    """(value, status). The tokens are fixed values."""
    raw = F.coalesce(clean_text(text), F.lit(""))
    number = raw.try_cast("double")
    low = F.replace(F.lower(raw), F.lit(" "), F.lit(""))
    status = (
        F.when(number.isNotNull(), "measured_numeric")
        .when(low.isin("b.d.l.", "bdl", "b.d.l"), "below_detection")
        .when(F.upper(raw) == "NA", "na_token_unresolved")
        .when(raw.isin("-", "–", "—"), "dash")
        .when(raw == "", "missing")
        .otherwise("unparsed_text")
    )
    return number, status


def unit_scale(unit: Column | str) -> tuple[Column, Column]:
    """(factor, base unit) of a unit's wording."""
    key = F.lower(F.replace(_c(unit), F.lit("'"), F.lit("")))
    factor = F.when(key.contains("million tonne"), 1e6).when(key.contains("000 tonne"), 1e3).when(key.contains("tonne") | key.contains("kilogram") | key.contains("carat"), 1.0)
    base = F.when(key.contains("tonne"), "tonnes").when(key.contains("kilogram"), "kilograms").when(key.contains("carat"), "carats")
    return factor, base


def complete(*columns: Column | str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & _c(c).isNotNull()
    return out
