"""Text and JSON-array column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: texts that stand for "no value" ---------------------------
NULL_TOKENS = ("", "null", "nan", "none", "nat", "na")
MODE_NULL_TOKENS = ("", "null", "nan", "none", "na")
CSV_NULL_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# -----------------------------------------------------------------------------

# Unicode white space plus the four ASCII separators, once as characters to trim and
# once as a regex class.
WHITE_SPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
WHITE_SPACE_CLASS = r"[\s\x1c-\x1f]"


def trim_ws(c: Column) -> Column:
    """Strip every kind of white space, not only spaces as plain ``trim`` does."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(trim_ws(c), rf"(?U){WHITE_SPACE_CLASS}+", " ")


def is_null_like(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return c.isNull() | F.lower(trim_ws(c)).isin(*tokens)


def null_if_token(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Trimmed text, or null for null-like text."""
    return F.when(~is_null_like(c, tokens), trim_ws(c))


def null_if_csv_na(c: Column) -> Column:
    """Null for the strings a CSV reader conventionally takes as missing."""
    return F.when(~c.isin(*CSV_NULL_STRINGS), c)


def json_elements(c: Column) -> Column:
    """Elements of a JSON array text as ``ARRAY<VARIANT>``; ``[]`` for anything else.

    The JSON parser stops at the end of the first value, so text after it would go
    unnoticed. When the first ``]`` is the last character nothing can follow. Otherwise
    the text must also parse both inside ``[...]`` and as an object member: what may
    follow a value in one place is an error in the other.
    """
    empty = F.array().cast("array<variant>")

    def listed(parsed: Column) -> Column:
        text, value = parsed["text"], parsed["value"]
        plain = F.instr(text, "]") == F.length(text)
        one_value = (
            F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
            & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
        )
        return F.when(plain | one_value, F.try_variant_get(value, "$", "array<variant>"))

    def parsed(text: Column) -> Column:
        return F.struct(text.alias("text"), F.try_parse_json(text).alias("value"))

    def mended(parsed_text: Column) -> Column:
        # Bare NaN and Infinity are no JSON; they stand for elements without a value.
        bare = F.regexp_replace(parsed_text["text"], r"(?<=[\[,\s])-?(NaN|Infinity)(?=\s*[,\]])", "null")
        return F.when(parsed_text["value"].isNull(), parsed(bare)).otherwise(parsed_text)

    # Each step is bound once as the only element of an array, so a text is parsed once.
    steps = F.filter(F.array(trim_ws(c)), lambda text: text.startswith("["))
    for step in (parsed, mended, listed):
        steps = F.transform(steps, step)
    return F.coalesce(F.get(steps, F.lit(0)), empty)


def json_string_array(c: Column) -> Column:
    """JSON array text as ``ARRAY<STRING>``, elements unchanged, source order."""
    return F.transform(json_elements(c), lambda v: F.try_variant_get(v, "$", "string"))


def normalise_tokens(tokens: Column) -> Column:
    """Trim and upper-case an ``ARRAY<STRING>``; null-like elements are dropped."""
    return F.transform(
        F.filter(tokens, lambda t: ~is_null_like(t)), lambda t: F.upper(trim_ws(t))
    )


def violation_tokens(c: Column) -> Column:
    """Normalised token list of a JSON-array cell."""
    return normalise_tokens(json_string_array(c))


def _offence_code(element: Column) -> Column:
    v, kind = element["v"], element["kind"]
    number = F.try_variant_get(v, "$", "double")
    text = trim_ws(F.try_variant_get(v, "$", "string"))
    return (
        F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(
            (kind == "STRING") & text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"),
            F.regexp_replace(text, "_", "").try_cast("bigint"),
        )
        .when(
            kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number)),
            F.try_variant_get(v, "$", "bigint"),
        )
    )


def offence_codes(c: Column) -> Column:
    """Integer-convertible elements of a JSON-array cell as ``ARRAY<BIGINT>``."""
    typed = F.transform(
        json_elements(c),
        lambda v: F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")),
    )
    return F.filter(F.transform(typed, _offence_code), lambda code: code.isNotNull())
