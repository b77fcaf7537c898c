"""Diagnosis-style codes: formatting, list parsing, and reading arrays of codes out of model responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = " \t\n\r\x0b\x0c"
_CODE = "(F[0-9]{2}(?:\\.[0-9]+)?)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def format_code(c: Column) -> Column:
    """A point after the third character of a longer code that has none: F329 -> F32.9."""
    s = strip(c)
    return F.when((F.length(s) > 3) & ~F.contains(s, F.lit(".")), F.concat(F.substring(s, 1, 3), F.lit("."), F.substr(s, F.lit(4)))).otherwise(s)


def _full(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def comma_list(c: Column, formatted: bool = True) -> Column:
    """Parts between commas, stripped; null gives an empty list."""
    parts = F.split(F.coalesce(c, F.lit("")), ",", -1)
    return F.transform(parts, format_code if formatted else strip)


def mixed_list(c: Column) -> Column:
    """Parts between commas or blanks, formatted, only F codes."""
    parts = F.transform(_full(F.split(F.coalesce(c, F.lit("")), "[,\\s]+", -1)), format_code)
    return F.filter(parts, lambda x: x.startswith("F"))


def comma_codes(c: Column) -> Column:
    """Parts between commas, formatted, only F codes; null and empty give an empty list."""
    return F.filter(comma_list(c), lambda x: x.startswith("F"))


def blank_list(c: Column) -> Column:
    """Parts between blanks without commas at their ends; neither formatted nor filtered."""
    return F.transform(_full(F.split(strip(F.coalesce(c, F.lit(""))), "\\s+", -1)), lambda x: F.btrim(x, F.lit(",")))


def comma_or_blank_codes(c: Column) -> Column:
    """Commas count as blanks; only F codes, as written."""
    parts = _full(F.split(strip(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(" "))), "\\s+", -1))
    return F.filter(parts, lambda x: x.startswith("F"))


def semicolon_list(c: Column) -> Column:
    """Parts between '; ', stripped, without empty ones."""
    return _full(F.transform(F.split(F.coalesce(c, F.lit("")), "; ", -1), strip))


def codes_json(c: Column) -> Column:
    """A JSON array of strings, with a blank after each comma."""
    return F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]")))


def is_code_json(c: Column) -> Column:
    """True for a JSON array that has only strings beginning with F."""
    parsed = F.from_json(c, "array<string>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    kinds = F.schema_of_variant(F.try_parse_json(c))
    ok = kinds.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(parsed, lambda x: x.startswith("F"))
    return F.coalesce(ok, F.lit(False))


def _strict_json(c: Column) -> Column:
    """True if the whole text is one JSON value: lenient readers take what follows a value for granted."""
    whole = F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}"))).isNotNull()
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit(",0]"))), "$[1]", "int") == 0
    return F.coalesce(whole & alone, F.lit(False))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _unfenced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "```json\\s*", ""), "```\\s*", "")


def _array_items(c: Column) -> Column:
    """Items of a JSON array as (kind, text, code, code_kind)."""
    items = F.variant_get(F.try_parse_json(c), "$", "array<variant>")

    def item(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        code = F.try_variant_get(v, "$.code", "variant")
        is_object = kind.startswith("OBJECT")
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("text"),
            F.when(is_object, F.try_variant_get(v, "$.code", "string")).alias("code"),
            F.when(is_object & code.isNotNull(), F.schema_of_variant(code)).alias("code_kind"),
        )

    return F.transform(items, item)


def response_codes(c: Column, checked: bool = False) -> Column:
    """Codes of a response: the JSON array between the first [ and the last ], else all codes that are mentioned.

    Strings that begin with F count, and the ``code`` of objects (``checked``: only if that is such a string). Without
    brackets, or if what lies between them isn't JSON, the distinct codes of the response in order are taken.
    """
    mentioned = F.array_distinct(F.regexp_extract_all(c, F.lit(_CODE), F.lit(1)))

    def chosen(x: Column) -> Column:
        own = F.when((x["kind"] == "STRING") & x["text"].startswith("F"), x["text"])
        code = x["code"]
        if checked:
            code = F.when((x["code_kind"] == "STRING") & code.startswith("F"), code)
        return F.coalesce(own, F.when(x["kind"].startswith("OBJECT"), code))

    def part(text: Column) -> Column:
        left, right = F.instr(text, "["), F.length(text) - F.instr(F.reverse(text), "]") + 1
        return F.when((left > 0) & (right >= left) & (right <= F.length(text)), F.substr(text, left, right - left + 1))

    def listed(p: Column) -> Column:
        codes = F.filter(F.transform(_array_items(p), chosen), lambda x: x.isNotNull())
        return F.when(_strict_json(p), F.coalesce(codes, F.array().cast("array<string>")))

    return F.coalesce(_let(_let(_unfenced(c), part), listed), mentioned)


def checkpoint_codes(c: Column, most: int = 5) -> Column:
    """Codes of a response as the checkpoint selection reads them: only a text that begins with [ counts as JSON;
    else the first ``most`` distinct codes mentioned."""
    mentioned = F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit("(F[0-9]{2}(?:\\.[0-9]{1,3})?)"), F.lit(1))), 1, most)

    def part(text: Column) -> Column:
        back = F.instr(F.reverse(text), "]")
        return F.when(text.startswith("["), F.when(back > 0, F.substr(text, F.lit(1), F.length(text) - back + 1)).otherwise(text))

    def listed(p: Column) -> Column:
        codes = F.filter(F.transform(_array_items(p), lambda x: F.coalesce(x["code"], x["text"])), lambda x: x.startswith("F"))
        return F.when(_strict_json(p), F.struct(codes.alias("codes")))

    found = _let(_let(strip(_unfenced(c)), part), listed)
    return F.when(found.isNotNull(), found["codes"]).otherwise(mentioned)


def assistant_segment(c: Column, marker: str = "<|start|>assistant") -> Column:
    """What follows the last marker, stripped."""
    return strip(F.substring_index(c, marker, -1))


def normal_id(c: Column) -> Column:
    """Whole numbers in plain form, other ids as they are."""
    return F.coalesce(c.cast("string").try_cast("bigint").cast("string"), c.cast("string"))


#: Categories of codes by their first three characters, in order of display; fixed values.
CATEGORIES = {
    "Substance Use": "F10 F11 F12 F13 F14 F15 F16 F17 F18 F19".split(),
    "Mood Disorders": "F30 F31 F32 F33 F34 F39".split(),
    "Anxiety Disorders": "F40 F41 F42 F43 F44 F45 F48".split(),
    "Cognitive Disorders": "F00 F01 F02 F03 F04 F05 F06 F07 F09".split(),
    "Psychotic Disorders": "F20 F21 F22 F23 F24 F25 F28 F29".split(),
    "Other": "F50 F51 F60 F63 F70 F79 F80 F84 F90 F91 F99".split(),
}
#: Substances by prefix; fixed values.
SUBSTANCES = {
    "F10": "Alcohol", "F11": "Opioid", "F12": "Cannabis", "F13": "Sedative", "F14": "Cocaine",
    "F15": "Stimulant", "F16": "Hallucinogen", "F17": "Nicotine", "F18": "Inhalant", "F19": "Multiple/Other",
}
#: Chapters by the first two characters; fixed values.
CHAPTERS = {
    "F0": "F00-F09", "F1": "F10-F19", "F2": "F20-F29", "F3": "F30-F39", "F4": "F40-F48",
    "F5": "F50-F59", "F6": "F60-F69", "F7": "F70-F79", "F8": "F80-F89", "F9": "F90-F99",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def category(c: Column) -> Column:
    return F.coalesce(_lookup(F.substring(c, 1, 3), {p: n for n, prefixes in CATEGORIES.items() for p in prefixes}), F.lit("Other"))


def substance(c: Column) -> Column:
    return _lookup(F.substring(c, 1, 3), SUBSTANCES)


def chapter(c: Column) -> Column:
    return F.coalesce(_lookup(F.substring(c, 1, 2), CHAPTERS), F.lit("neutral"))


def severity(c: Column) -> Column:
    """By the character after the point; codes too short for one are Other."""
    fifth = F.substring(c, 5, 1)
    return F.when(F.length(c) < 5, "Other").when(fifth == "1", "Abuse").when(fifth == "2", "Dependence").when(fifth == "9", "Unspecified").otherwise("Other")


def remission(c: Column) -> Column:
    sixth = F.substring(c, 6, 1)
    return F.when(F.length(c) < 6, "Unknown").when(sixth == "1", "In Remission").when(sixth == "0", "Active").otherwise("Unknown")
