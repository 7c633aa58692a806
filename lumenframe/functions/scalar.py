"""Scalar functions of the catalogue and the editor as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TAGS, TAG_CHARS, STACK_CHARS = 32, 40, 120


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column) -> Column:
    """Rounded half toward plus infinity."""
    return F.floor(x + 0.5)


# Tags, keys, names


def tag(x: Column) -> Column:
    t = F.left(F.trim(F.lower(F.regexp_replace(F.regexp_replace(x, r"\|", " "), r"\s+", " "))), F.lit(TAG_CHARS))
    return F.nullif(t, F.lit(""))


def tags(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), r"\|"), lambda t: t != "")


def frame_tags(found: Column) -> Column:
    kept = F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda t: t.isNotNull()))), 1, MAX_TAGS)
    return F.when(F.size(kept) > 0, F.concat(F.lit("|"), F.array_join(kept, "|"), F.lit("|"))).otherwise(F.lit(""))


def add_tag(held: Column | str, t: Column) -> Column:
    return frame_tags(F.array_union(tags(held), F.array(tag(t))))


def remove_tag(held: Column | str, t: Column) -> Column:
    return frame_tags(F.array_except(tags(held), F.array(tag(t))))


def stack_key(name: Column | str) -> Column:
    n = _c(name)
    return F.left(F.lower(F.when(n.rlike(r"^.+\.[^.]*$"), F.regexp_extract(n, r"^(.+)\.[^.]*$", 1)).otherwise(n)), F.lit(STACK_CHARS))


def fingerprint(size: Column, content: Column) -> Column:
    """``size:sha256 of the first 64 KiB:sha256 of the last 64 KiB`` of binary content."""
    edge = 65536
    return F.concat_ws(":", size.cast("string"), F.sha2(F.substring(content, 1, edge), 256), F.sha2(F.substring(content, F.greatest(F.octet_length(content) - edge + 1, F.lit(1)), F.lit(edge)), 256))


def toggle(held: Column, x: Column) -> Column:
    return F.when(F.array_contains(held, x), F.array_remove(held, x)).otherwise(F.array_append(held, x))


def move_to_front(held: Column, x: Column, most: int) -> Column:
    return F.slice(F.concat(F.array(x), F.array_remove(held, x)), 1, most)


def pack_mask(flags: Column, rating: Column, color: Column) -> Column:
    return (flags.bitwiseOR(F.shiftleft(rating, 3)).bitwiseOR(F.shiftleft(color, 6))).cast("bigint")


def unpack_mask(mask: Column) -> list[Column]:
    bits = lambda at, n: F.shiftright(mask, at).bitwiseAND(F.lit(n))
    return [bits(0, 7).alias("flags"), F.least(bits(3, 7), F.lit(5)).alias("rating"), bits(6, 15).alias("color")]


def extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(name), r"\.([^./]*)$", 1))


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def strip_brand(lens: Column, make: Column) -> Column:
    brand, name = F.trim(F.substring_index(F.trim(make), " ", 1)), F.trim(lens)
    n = F.char_length(brand)
    doubled = (n > 0) & (F.char_length(name) > n + 1) & (F.lower(F.left(name, n)) == F.lower(brand)) & (F.substring(name, n + 1, F.lit(1)) == " ")
    return F.when(doubled, F.trim(F.substring(name, n + 2, F.lit(100000)))).otherwise(name)


def lens_needles(query: Column | str) -> Column:
    """A lens query as distinct search words: focal lengths with unit, apertures, then words of two letters and more."""
    noise = ["fast", "prime", "lens", "camera", "the", "and"]
    focal, aperture = r"(\d{1,3}(?:\.\d+)?(?:-\d{1,3}(?:\.\d+)?)?)\s*mm", r"f\s*/?\s*(\d(?:\.\d+)?)|(?<![\d.])(\d\.\d)(?![\d.])"
    text = F.replace(F.lower(F.trim(_c(query))), F.lit("nifty fifty"), F.lit("50mm f/1.8"))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(focal), F.lit(1)), lambda x: F.concat(x, F.lit("mm")))
    rest = F.regexp_replace(text, focal, " ")
    stops = F.transform(F.regexp_extract_all(rest, F.lit(aperture), F.lit(0)), lambda x: F.regexp_extract(x, r"(\d(?:\.\d+)?)\s*$", 1))
    words = F.filter(F.split(F.regexp_replace(rest, aperture, " "), r"\s+"), lambda w: (F.char_length(w) >= 2) & ~w.isin(noise))
    return F.array_distinct(F.concat(lengths, stops, words))


def expand_name(template: str, values: dict[str, Column]) -> Column:
    r"""A file name template with its ``\x`` marks replaced; an upper-case mark gives the value in upper case."""
    out = F.lit(template)
    for mark, value in values.items():
        out = F.replace(out, F.lit("\\" + mark), F.coalesce(value.cast("string"), F.lit("")))
        out = F.replace(out, F.lit("\\" + mark.upper()), F.upper(F.coalesce(value.cast("string"), F.lit(""))))
    return out


# Numbers and text


def human_size(bytes_: Column | str) -> Column:
    """Under 1024 plain; else divided by 1024, with one decimal, until the next unit would read 1000 or more."""
    b = _c(bytes_)
    out, steps = F.lit(None).cast("string"), []
    for k, unit in enumerate("kMGTPE"):
        scaled = ((b - b % 1024**k) / 1024**k).cast("bigint") if k else b  # cut towards 0
        steps.append((F.abs(scaled) < 999950, F.concat(F.replace(F.format_string("%.1f", scaled / F.lit(1024.0)), F.lit(",0"), F.lit("")), F.lit(f" {unit}B"))))
    for cond, text in reversed(steps):
        out = F.when(cond, text).otherwise(out)
    return F.when(F.abs(b) < 1024, F.concat(b.cast("string"), F.lit(" B"))).otherwise(out)


def trim_zeros(s: Column | str) -> Column:
    x = _c(s)
    return F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0*$", ""), r"\.$", "")).otherwise(x)


def round_to(x: Column, digits: int) -> Column:
    return half_up(x * 10**digits) / F.lit(float(10**digits))


def nearest_odd(x: Column) -> Column:
    n = half_up(x)
    return F.when(n % 2 != 0, n).otherwise(n + 1)


def is_base64(s: Column) -> Column:
    return s.rlike(r"^(?=(.{4})*$)[A-Za-z0-9+/]*={0,2}$") & (F.char_length(s) > 0)


def strip_base64(s: Column) -> Column:
    x = F.regexp_replace(s, r"\s", "")
    return F.when(x.contains(","), F.regexp_extract(x, r"^[^,]*,(.*)$", 1)).otherwise(x)


def min_sec(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def rational(s: Column | str) -> Column:
    """``a/b`` or a plain number; null where it is neither, or b is 0."""
    x = F.trim(_c(s))
    number = lambda t: F.when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), t).cast("double")
    return F.when(x.contains("/"), F.try_divide(number(F.substring_index(x, "/", 1)), number(F.substring_index(x, "/", -1)))).otherwise(number(x))


# Dates; "now" is always a parameter


def relative_day(ts: Column, now: int) -> Column:
    """Today, Yesterday, the weekday up to five days back, else the date, with the year if it is another one. Seconds."""
    t, n = F.timestamp_seconds(ts), F.timestamp_seconds(F.lit(now))
    days = ((F.lit(now) - ts) * 1000 / 86_400_000).cast("int")
    date = F.when(F.year(n) > F.year(t), F.date_format(t, "EEEE, MMMM d, yyyy")).otherwise(F.date_format(t, "EEEE, MMMM d"))
    same = F.dayofmonth(n) == F.dayofmonth(t)
    return F.when(days == 0, F.when(same, "Today").otherwise("Yesterday")).when(days == 1, "Yesterday").when(days.between(2, 5), F.date_format(t, "EEEE")).otherwise(date)


def month_label(ts: Column, now: int) -> Column:
    t = F.timestamp_seconds(ts)
    return F.when(F.year(t) != F.year(F.timestamp_seconds(F.lit(now))), F.date_format(t, "MMMM yyyy")).otherwise(F.date_format(t, "MMMM"))


def range_header(first: Column, last: Column) -> Column:
    a, b = F.timestamp_seconds(first), F.timestamp_seconds(last)
    m = lambda t: F.date_format(t, "MMMM d")
    y = lambda t: F.date_format(t, "yyyy")
    same_year, same_month, same_day = F.year(a) == F.year(b), F.month(a) == F.month(b), F.dayofmonth(a) == F.dayofmonth(b)
    inside = F.when(same_month & same_day, F.concat(m(a), F.lit(", "), y(a))).when(same_month, F.concat(m(a), F.lit(" - "), F.date_format(b, "d"), F.lit(", "), y(a))).otherwise(F.concat(m(a), F.lit(" - "), m(b), F.lit(", "), y(a)))
    return F.when(same_year, inside).otherwise(F.concat(m(a), F.lit(", "), y(a), F.lit(" - "), m(b), F.lit(", "), y(b)))


# Exposure rules. Thresholds and results.


def _ladder(x: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    out = F.lit(rest)
    for limit, value in reversed(steps):
        out = F.when(x <= limit, F.lit(value)).otherwise(out)
    return out


def iso_to_apex(iso: Column) -> Column:
    return F.when(iso <= 0, 56).otherwise(clamp(72 + half_up(8.0 * (F.log2(iso.cast("double")) - F.log2(F.lit(100.0)))), 56, 136)).cast("int")


def apex_to_iso(index: Column) -> Column:
    return half_up(100.0 * F.pow(F.lit(2.0), (clamp(index, 56, 136) - 72.0) / 8.0)).cast("int")


def noise_luma(iso: Column) -> Column:
    return _ladder(iso, [(200, 0.0), (400, 5.0), (800, 12.0), (1600, 22.0), (3200, 35.0), (6400, 50.0)], 65.0)


def noise_chroma(iso: Column) -> Column:
    return _ladder(iso, [(200, 0.0), (400, 3.0), (800, 8.0), (1600, 15.0), (3200, 25.0), (6400, 38.0)], 50.0)


def white_balance(kelvin: Column) -> Column:
    return F.when(kelvin == 0, 0.0).when(kelvin < 3500, 0.08).when(kelvin < 4500, 0.04).when(kelvin <= 6000, 0.0).when(kelvin <= 7500, -0.02).otherwise(-0.04)


def ettr_bias(light: Column) -> Column:
    return F.when(light > 200, -0.5).when(light < 30, 0.3).otherwise(0.0)


def diffraction(aperture: Column, crop: Column) -> Column:
    limit = 11.0 / crop
    return F.when((aperture <= 0) | (crop <= 0), 0.0).when(aperture <= limit, 0.0).otherwise(F.least(F.lit(30.0), (aperture - limit) * 6.0))


def thermal(shutter: Column, base: Column, slope: float, cap: float) -> Column:
    boost = F.least(F.lit(cap), F.greatest(slope * F.log2(shutter), F.lit(0.0)))
    return F.when(shutter <= 1, base).otherwise(clamp(base + boost, 0.0, 100.0))


def focus_ratio(near_m: Column, aperture: Column, focal: Column, coc: float = 0.03) -> Column:
    """How far in front of the hyperfocal distance, 0 to 1."""
    hyperfocal = focal * focal / (aperture * coc) + focal
    return F.when((near_m <= 0) | (aperture <= 0) | (focal <= 0), 0.0).otherwise(clamp(1 - near_m * 1000.0 / hyperfocal, 0.0, 1.0))


def flash_wb(fired: Column, light: Column, kelvin: Column) -> Column:
    by_kelvin = F.when(kelvin < 3500, -8.0).when(kelvin <= 4500, -2.0).when(kelvin > 6500, 3.0).otherwise(0.0)
    return F.when(~fired, 0.0).when(light == 3, -8.0).when(light == 2, -2.0).when(light.isin(1, 9, 10), 0.0).otherwise(by_kelvin)


def kelvin_estimate(sum_r: Column, sum_b: Column) -> Column:
    ratio = F.when(sum_b > 1, sum_r / sum_b).otherwise(1.3)
    return clamp((5500.0 / ratio).cast("int"), 2000, 10000)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def chroma_blue(r: Column, g: Column, b: Column) -> Column:
    return -0.16874 * r - 0.33126 * g + 0.5 * b


def chroma_red(r: Column, g: Column, b: Column) -> Column:
    return 0.5 * r - 0.41869 * g - 0.08131 * b


def scene(avg_luma: Column, avg_chroma: Column, kelvin: Column, luma_range: Column) -> Column:
    """The first rule that fits."""
    return (
        F.when((avg_luma < 70) & (luma_range > 50), "Night Scene").when(avg_luma < 70, "Underexposed").when((kelvin > 5800) & (avg_luma > 100), "Golden Hour")
        .when((kelvin < 4500) & avg_luma.between(60, 140), "Indoor Tungsten").when((avg_chroma < 25) & (avg_luma > 80), "Flat/Desaturated").when(luma_range > 160, "High Contrast").otherwise("Neutral")
    )


def mirror(index: Column, size: int) -> Column:
    """Index reflected into 0 .. size - 1 without repeating the edge."""
    if size == 1:
        return F.lit(0)
    k = F.pmod(index, F.lit(2 * size - 2))
    return F.when(k < size, k).otherwise(2 * size - 2 - k)


def percent_size(length: Column, percent: int) -> Column:
    return (length * (percent / 100.0)).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Picture styles of maker note codes, and the styles whose bias counts half.
STYLE_CODES = {129: "STANDARD", 130: "PORTRAIT", 131: "LANDSCAPE", 132: "NEUTRAL", 133: "FAITHFUL", 134: "MONOCHROME", 33: "USER_DEF", 0: "AUTO"}
MILD_STYLES = ["NEUTRAL", "FAITHFUL"]


def picture_style(make: Column, code: Column) -> Column:
    """The style of a Canon body's code, AUTO for an unknown one; STANDARD for other makes or without a code."""
    named = F.lit("AUTO")
    for value, name in STYLE_CODES.items():
        named = F.when(code == value, name).otherwise(named)
    return F.when(F.lower(make).contains("canon") & code.isNotNull(), named).otherwise("STANDARD")


def style_scale(style: Column) -> Column:
    return F.when(style.isin(MILD_STYLES), 0.5).otherwise(1.0)


def aspect_size(width: Column, height: Column, ratio: Column, fit: Column) -> Column:
    """struct(width, height) of the given ratio: inside the picture, or with ``fit`` around it; one of the sides stays."""
    own = width.cast("double") / height
    keeps_height = F.when(fit, ratio > own).otherwise(ratio < own)
    size = lambda w, h: F.struct(half_up(w).cast("int").alias("width"), half_up(h).cast("int").alias("height"))
    return F.when(keeps_height, size(height * ratio, height.cast("double"))).otherwise(size(width.cast("double"), width / ratio))


def has_extension(uri: Column, extension: Column) -> Column:
    """Whether ``uri`` ends with the extension; with none, or ``*``, all do."""
    return extension.isNull() | (extension == "*") | uri.endswith(extension)


def matches_either(words: str, *texts: Column) -> Column:
    """Whether one of the texts contains ``words``, in any case; without words, all do."""
    hit = F.lit(not words)
    for t in texts:
        hit = hit | F.lower(t).contains(words.lower())
    return hit


def replace_at(items: Column, index: Column, change: Callable[[Column], Column]) -> Column:
    """``items`` with ``change`` applied to the one at ``index``, from 0."""
    return F.transform(items, lambda x, i: F.when(i == index, change(x)).otherwise(x))


def toggle_kind(items: Column, item: Column, kind: str) -> Column:
    """Without those of the item's ``kind`` (a field), or, if there are none, with the item at the end."""
    same = lambda x: x[kind] == item[kind]
    return F.when(F.exists(items, same), F.filter(items, lambda x: ~same(x))).otherwise(F.concat(items, F.array(item)))


#: The known keys of develop settings and the unit that their numbers are counted in.
SETTING_UNITS = {"Exposure2012": 5.0, "Contrast2012": 100.0, "Highlights2012": 100.0, "Shadows2012": 100.0, "Whites2012": 100.0, "Blacks2012": 100.0}
HSL_KINDS = ["HueAdjustment", "SaturationAdjustment", "LuminanceAdjustment"]


def develop_settings(text: Column | str) -> Column:
    """Map of settings in ``name="number"`` attributes, prefixes of the names stripped, in units of 1; unknown names and other values are left out, the last of a name wins."""
    pairs = F.regexp_extract_all(_c(text), F.lit(r'[\w:.]+\s*=\s*"[^"]*"'), F.lit(0))
    unit = lambda k: F.coalesce(*[F.when(k == name, u) for name, u in SETTING_UNITS.items()], F.when(k.rlike(f"^({'|'.join(HSL_KINDS)})."), 100.0))
    read = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r'([\w.]+)\s*=', 1).alias("k"), F.regexp_extract(p, r'"\s*([-+]?[0-9]*\.?[0-9]+)', 1).try_cast("double").alias("v")))
    known = F.filter(F.transform(read, lambda x: F.struct(x["k"].alias("k"), (x["v"] / unit(x["k"])).alias("v"))), lambda x: x["v"].isNotNull())
    # A fold reads ``known`` once; a filter that compares it with itself would make it anew, matches and all, for each pair.
    last = F.aggregate(known, F.array().cast("array<struct<k:string,v:double>>"), lambda kept, x: F.concat(F.filter(kept, lambda y: y["k"] != x["k"]), F.array(x)))
    return F.map_from_entries(last)


#: No XML document can hold this character, so it parts values without being in one.
_PART = "\u0001"


def xpath_values(xml: Column, expressions: dict[str, str]) -> dict[str, Column]:
    """The values, as strings, of several XPath expressions by their names; the document is parsed once, not once for each."""
    parts = f", '{_PART}', ".join(f"string({e})" for e in expressions.values())
    whole = f"concat({parts}, '')"
    values = F.split(F.xpath_string(xml, F.lit(whole)), _PART, -1)
    return {name: F.element_at(values, k + 1) for k, name in enumerate(expressions)}
