"""JSON log lines: strict validity, typed fields, value text and levels.

All of it runs on Spark's VARIANT type inside the JVM. A line counts only if it
is *exactly* one JSON object: the plain parser stops after the first value and
would let ``{"a":1} junk`` pass, so the line is parsed as the single element of
an array; a line containing ``]`` could close that array early, so it must also
survive as the value of an object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.basics import as_col, bind

# Keys that may hold a level, in order, and the level words.
LEVEL_KEYS = ("level", "severity", "log_level", "type")
LEVEL_WORDS = {
    "fatal": ("fatal", "critical", "alert", "emergency", "panic"),
    "error": ("error", "err"),
    "warning": ("warning", "warn"),
    "info": ("info", "information"),
    "debug": ("debug", "trace"),
}


def _path(key: str, prefix: str = "$") -> str:
    return f'{prefix}["{key}"]' if "'" in key else f"{prefix}['{key}']"


def json_object(line) -> Column:
    """The line as a VARIANT object; NULL unless it is exactly one JSON object."""
    text = as_col(line)
    as_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_value = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(
        text.rlike(r"^[ \t\r\n]*\{"),
        bind(
            as_list,
            lambda v: F.when(
                F.try_variant_get(v, "$[1]", "variant").isNull()
                & (~F.contains(text, F.lit("]")) | as_value.isNotNull()),
                F.try_variant_get(v, "$[0]", "variant"),
            ),
        ),
    )


def is_json_object(line) -> Column:
    return F.coalesce(json_object(line).isNotNull(), F.lit(False))


def field_type(obj: Column, key: str) -> Column:
    """``STRING``, ``BIGINT``, ``DECIMAL(p,s)``, ``DOUBLE``, ``BOOLEAN``, ``VOID``,
    ``OBJECT<..>``, ``ARRAY<..>``, or NULL when the key is absent."""
    return F.schema_of_variant(F.try_variant_get(obj, _path(key), "variant"))


def field_text(obj: Column, key: str) -> Column:
    return F.try_variant_get(obj, _path(key), "string")


def _number_text(number: Column) -> Column:
    """Shortest decimal form; exponent form below 1e-4 and from 1e6 on.

    Spark prints a double as ``ddd.ddd`` or ``d.dddE±n``; both are taken apart
    into sign, digits and exponent and put together again.
    """
    def take_apart(s: Column) -> Column:
        mantissa = F.regexp_extract(s, r"^-?([0-9.]+)", 1)
        power = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
        return bind(
            F.struct(
                F.substring_index(mantissa, ".", 1).alias("left"),
                F.regexp_replace(F.regexp_extract(mantissa, r"\.(\d*)", 1), "0+$", "").alias("right"),
            ),
            lambda m: F.struct(
                F.when(s.startswith("-"), "-").otherwise("").alias("sign"),
                F.regexp_replace(F.concat(m["left"], m["right"]), "^0+|0+$", "").alias("sig"),
                (
                    F.length(m["left"]) - 1 + F.coalesce(power, F.lit(0))
                    - F.length(F.regexp_extract(F.concat(m["left"], m["right"]), "^(0*)", 1))
                ).alias("exp"),
            ),
        )

    def put_together(p: Column) -> Column:
        sig, exp, n = p["sig"], p["exp"], F.length(p["sig"])
        shown = F.abs(exp).cast("string")
        scientific = F.concat(
            F.substring(sig, 1, 1),
            F.when(n > 1, F.concat(F.lit("."), F.substring(sig, F.lit(2), n))).otherwise(""),
            F.when(exp < 0, "e-").otherwise("e+"),
            F.lpad(shown, F.greatest(F.lit(2), F.length(shown)), F.lit("0")),
        )
        body = (
            F.when(sig == "", F.lit("0"))
            .when((exp < -4) | (exp >= 6), scientific)
            .when(exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), sig))
            .when(n <= exp + 1, F.rpad(sig, exp + 1, F.lit("0")))
            .otherwise(F.concat(F.substring(sig, F.lit(1), exp + 1), F.lit("."), F.substring(sig, exp + 2, n)))
        )
        return F.concat(p["sign"], body)

    return bind(bind(number.cast("string"), take_apart), put_together)


#: A string, a sign, or what stands between signs, in JSON text.
_TOKEN = r'("(?:[^"\\]|\\.)*"|[{}\[\],:]|[^{}\[\],:"\s]+)'


def _nested_text(json: Column) -> Column:
    """``map[key:value ...]`` and ``[a b]`` of an object or array given as JSON text with sorted keys, to
    any depth: each token is spelt anew, so nothing has to recurse."""
    def spelt(token: Column) -> Column:
        return (
            F.when(token == "{", F.lit("map["))
            .when(token == "}", F.lit("]"))
            .when(token == ",", F.lit(" "))
            .when(token.isin("[", "]", ":", "true", "false"), token)
            .when(token == "null", F.lit("<nil>"))
            .when(token.startswith('"'), F.try_variant_get(F.try_parse_json(token), "$", "string"))
            .otherwise(_number_text(token.cast("double")))
        )

    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(1)), spelt), "")


def go_value_string(obj: Column, key: str) -> Column:
    """The text a field is matched as: strings as they are, ``true``/``false``, ``<nil>`` for null,
    numbers as shortest floats, objects as ``map[key:value ...]`` with sorted keys, arrays as ``[a b]``."""
    def shown(kind: Column) -> Column:
        return (
            F.when(kind.isin("STRING", "BOOLEAN"), field_text(obj, key))
            .when(kind == "VOID", F.lit("<nil>"))
            .when(
                (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
                _number_text(F.try_variant_get(obj, _path(key), "double")),
            )
            .otherwise(_nested_text(F.to_json(F.try_variant_get(obj, _path(key), "variant"))))
        )

    return bind(field_type(obj, key), shown)


def json_context(line) -> Column:
    """The whole object as canonical JSON text, NULL when the line is not one."""
    return F.to_json(json_object(line))


def level_from_object(obj: Column) -> Column:
    """Level named by the first level key that holds a string; NULL when unknown."""
    word = F.lower(
        F.coalesce(*[F.when(field_type(obj, k) == "STRING", field_text(obj, k)) for k in LEVEL_KEYS])
    )
    chosen = F.lit(None).cast("string")
    for level, words in LEVEL_WORDS.items():
        chosen = F.when(word.isin(*words), level).otherwise(chosen)
    return chosen


def level_from_context(line) -> Column:
    return bind(json_object(line), level_from_object)


def split_key_pattern(pattern: str) -> tuple[str, str]:
    """``key:regex`` at the first colon, both halves trimmed."""
    key, colon, regex = pattern.partition(":")
    if not colon:
        raise ValueError(f"invalid json pattern format: expected 'key:regex', got '{pattern}'")
    return key.strip(), regex.strip()


def json_escape(text) -> Column:
    """Text as the inside of a JSON string."""
    wrapped = F.to_json(F.struct(as_col(text).alias("t")))
    return bind(wrapped, lambda w: F.substring(w, F.lit(7), F.length(w) - 8))
