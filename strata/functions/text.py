"""Text, JSON and hash helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label formats printed on drawings.
TICK = r"^CH-(\d{2,4})$"
SECTION_TICK = r"^CH-\d+/\d+$"
DEPTH = r"(?i)(?:^|[\dm])Depth=?(\d+(?:\.\d+)?)?m?$"
NUMBER = r"^(\d+(?:\.\d+)?)m?(?:[A-Za-z]+)?$"
LATITUDE = r"^Lat(\d{1,2}\.\d+)$"
LONGITUDE = r"^Long(\d{1,3}\.\d+)$"
# First characters a spreadsheet would read as a formula.
FORMULA_START = "^[=+\\-@\t\r]"
RESPONSE_FIELDS = ("what", "where", "why", "how", "recommended_action")


def _group(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def tick_value(text: Column) -> Column:
    """Chainage of a plan tick, also when the label was read upside down."""
    return F.coalesce(_group(text, TICK), _group(F.reverse(text), TICK)).cast("int")


def is_tick_label(text: Column) -> Column:
    turned = F.reverse(text)
    return text.rlike(TICK) | text.rlike(SECTION_TICK) | turned.rlike(TICK) | turned.rlike(SECTION_TICK)


def is_depth_word(text: Column) -> Column:
    return text.rlike(DEPTH)


def depth_value(text: Column) -> Column:
    """The number glued to a depth word, when there is one."""
    return _group(text, DEPTH).cast("double")


def number_value(text: Column) -> Column:
    return _group(text, NUMBER).cast("double")


def site_of(job: Column) -> Column:
    return F.split(job, "_", 2)[0]


def opposite_side(drawing: Column) -> Column:
    return F.when(drawing.contains("Rhs"), F.replace(drawing, F.lit("Rhs"), F.lit("Lhs"))).when(
        drawing.contains("Lhs"), F.replace(drawing, F.lit("Lhs"), F.lit("Rhs"))
    )


def xml_text(text: Column) -> Column:
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for raw, safe in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        clean = F.replace(clean, F.lit(raw), F.lit(safe))
    return clean


def spreadsheet_text(text: Column) -> Column:
    """A cell a spreadsheet will not run as a formula."""
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def layer_name(kind: Column, utility: Column, status: Column, origin: Column) -> Column:
    return (
        F.when(kind == "vendor_callout", F.concat(F.lit("VENDOR_"), F.replace(F.coalesce(utility, F.lit("UNKNOWN")), F.lit(" "), F.lit("_"))))
        .when(kind == "claim", F.concat(F.lit("CLAIM_"), F.upper(F.coalesce(status, F.lit("proposed")))))
        .when((kind == "target") & (origin == "interpreter pick"), "TARGET_PICK")
        .when(kind == "target", "TARGET_CANDIDATE")
        .when(kind == "radar_line", "RADAR_LINE")
        .when(kind == "line_location", "RADAR_LINE_LOCATION_ONLY")
        .otherwise("OTHER")
    )


def display_name(kind: Column, utility: Column, depth: Column, identity: Column, status: Column, ident: Column, origin: Column, chainage: Column) -> Column:
    return (
        F.when(kind == "vendor_callout", F.trim(F.concat(utility, F.lit(" "), F.coalesce(F.concat(F.format_string("%.2f", depth), F.lit(" m")), F.lit("")))))
        .when(kind == "claim", F.concat(identity, F.lit(" — "), status))
        .when(kind.isin("radar_line", "line_location"), ident)
        .otherwise(F.concat(F.coalesce(origin, F.lit("target")), F.lit(" "), F.coalesce(chainage.cast("string"), F.lit("")), F.lit(" m")))
    )


def described(fields: dict[str, Column]) -> Column:
    """One 'name: value' line per field that has a value."""
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c)) for name, c in fields.items()]
    return F.concat_ws("\n", F.array_compact(F.array(*lines)))


def evidence_line(name: str, value: Column, unit: str, confidence: Column) -> Column:
    return F.when(confidence == "unavailable", F.lit(f"{name}: unavailable")).otherwise(
        F.concat(F.lit(f"{name}: "), F.format_string("%.2f", value), F.lit(f" {unit} ("), confidence, F.lit(")"))
    )


RESPONSE_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RESPONSE_FIELDS])


def parse_response(raw: Column) -> Column:
    """(parsed, error): the response's five texts, or the first reason it cannot be used."""
    parsed = F.from_json(raw, RESPONSE_SCHEMA)
    error = F.when(parsed.isNull() | F.forall(F.array(*[parsed[f] for f in RESPONSE_FIELDS]), lambda v: v.isNull()), "not a JSON object")
    for f in RESPONSE_FIELDS:
        error = error.when(parsed[f].isNull() | (F.trim(parsed[f]) == ""), f"missing or blank: {f}")
    return F.struct(parsed.alias("parsed"), error.alias("error"))


def hash_percent(key: Column) -> Column:
    """A stable 0..99 from the key: its 256-bit digest modulo 100, folded one hex digit at a time."""
    digits = F.split(F.sha2(key, 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda acc, d: ((acc * 16 + F.conv(d, 16, 10).cast("int")) % 100).cast("int"))


def split_of(job: Column, val_percent: int = 20) -> Column:
    """A whole job goes to one side of the train/validation split."""
    return F.when(hash_percent(job) < val_percent, "val").otherwise("train")


def hash_uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the parts, the same on every engine and every retry."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def fingerprint(fields: dict[str, Column]) -> Column:
    """One digest of the named fields in order: the same request always gets the same key."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])), 256)
