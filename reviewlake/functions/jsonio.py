"""Strict JSON decoding: one complete value of the expected shape or nothing.

A value of another type than the schema's fails the whole text, also a number where a
text is expected or a fraction where a whole number is. Keys match whatever their case,
the exact one first; unknown keys are ignored; null and absent fields are null.

A text that one pattern shows to hold nothing but known keys with values of their types
is read by the typed parser. Any other is parsed as a variant and checked level by level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of variants that each type is read from.
_KINDS = {
    T.StringType: ("STRING",),
    T.BooleanType: ("BOOLEAN",),
    T.LongType: ("BIGINT",),
    T.IntegerType: ("BIGINT",),
    T.DoubleType: ("BIGINT", "DOUBLE", "FLOAT"),
}


def repeated_keys(spark: SparkSession) -> None:
    """Of a key that is written twice the last value counts; without this setting the text would be refused."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# JSON by patterns. Possessive throughout: they neither try again nor use the stack.
_GAP = r"[ \t\n\r]*+"
_ESCAPED = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
_PLAIN = {
    T.StringType: rf'"[^"\\\x00-\x1f]*+(?:{_ESCAPED}[^"\\\x00-\x1f]*+)*+"',
    T.BooleanType: "(?:true|false)",
    T.LongType: r"-?+(?:0|[1-9][0-9]{0,16}+)(?![0-9.eE])",
    T.IntegerType: r"-?+(?:0|[1-9][0-9]{0,7}+)(?![0-9.eE])",
    # Without a sign: the parsers differ in the sign of a zero.
    T.DoubleType: r"(?:0|[1-9][0-9]{0,14}+)(?:\.[0-9]{1,20}+)?+(?![0-9.eE])",
}


def _plain(dtype: T.DataType) -> str:
    """Pattern of the texts that the typed parser reads as the checks level by level do.

    Keys may come in any order, be absent or repeated, and only leaves may be null.
    """
    if isinstance(dtype, T.StructType):
        keys = [rf'"{f.name}"{_GAP}:{_GAP}{_plain(f.dataType)}' for f in dtype.fields]
        return rf"\{{{_GAP}{_listed('(?:' + '|'.join(keys) + ')')}\}}"
    if isinstance(dtype, T.ArrayType):
        return rf"\[{_GAP}{_listed(_plain(dtype.elementType))}\]"
    return rf"(?:{_PLAIN[type(dtype)]}|null)"


def _listed(one: str) -> str:
    """Any number of them: a comma stands between two, the closing mark behind the last."""
    return rf"(?:{one}{_GAP}(?:,{_GAP}(?![\]}}])|(?=[\]}}])))*+"


def decode_envelope(text: Column, schema: T.StructType) -> Column:
    """``ok`` and ``value`` of a text."""
    plain = text.rlike(rf"^{_GAP}{_plain(schema)}{_GAP}\z")
    return F.when(plain, _result(F.lit(True), F.from_json(text, schema))).otherwise(_checked(text, schema))


_ENVELOPES: dict[tuple, Column] = {}


def envelope(column: str, schema: T.StructType) -> Column:
    """``decode_envelope`` of a column by name, built once for all plans of a process: it is thousands of calls to the JVM."""
    key = (id(SparkContext._gateway), column, schema.json())
    if key not in _ENVELOPES:
        _ENVELOPES[key] = decode_envelope(F.col(column), schema)
    return _ENVELOPES[key]


def _checked(text: Column, schema: T.StructType) -> Column:
    """``ok`` and ``value`` of any text.

    The parser reads one value and ignores what follows it, so the text is put into a
    list with a closing field behind it. That field holds the text's own digest: a
    text that closes the list by itself cannot also write it.
    """
    closing = F.sha2(text, 256)
    wrapped = F.concat(F.lit('{"v":['), text, F.lit('],"end":"'), closing, F.lit('"}'))

    def opened(whole: Column) -> Column:
        items = F.try_variant_get(whole, "$.v", "array<variant>")
        closed = F.try_variant_get(whole, "$.end", "string") == closing
        single = F.coalesce(closed & (F.size(items) == 1), F.lit(False))
        return F.when(single, _decoded(F.get(items, F.lit(0)), schema))

    return _bound(F.try_parse_json(wrapped), opened)


def _decoded(value: Column, schema: T.StructType) -> Column:
    """``ok`` and ``value`` of a variant: in one cast where its own schema is the wanted one, else field by field."""

    def read(v: Column) -> Column:
        plain = F.schema_of_variant(v).rlike(f"^{_described(schema)}$")
        cast = F.try_variant_get(v, "$", schema.simpleString())
        return F.when(plain, _result(F.lit(True), cast)).otherwise(_typed(v, schema))

    return _bound(value, read)


def _described(dtype: T.DataType) -> str:
    """Pattern of the schemas, as ``schema_of_variant`` writes them, that need no test of their fields.

    It lists the keys in order and merges the items of a list: a type that differs
    between them is none of those here. A field that is null everywhere is VOID.
    """
    if isinstance(dtype, T.StructType):
        names = sorted(dtype.fields, key=lambda f: f.name)
        return "OBJECT<" + ", ".join(f"{f.name}: {_described(f.dataType)}" for f in names) + ">"
    if isinstance(dtype, T.ArrayType):
        return f"ARRAY<{_described(dtype.elementType)}>"
    kinds = "|".join(("VOID", *_KINDS[type(dtype)]))
    return rf"(?:{kinds}|DECIMAL\(\d+,\d+\))" if isinstance(dtype, T.DoubleType) else f"(?:{kinds})"


def _typed(value: Column, dtype: T.DataType) -> Column:
    """``ok`` and ``value`` of a variant; null, absent or of the JSON kind, is a null of any type."""

    def read(v: Column) -> Column:
        none = v.isNull() | F.is_variant_null(v)
        if isinstance(dtype, T.StructType):
            fields = F.try_variant_get(v, "$", "map<string,variant>")
            return _bound(fields, lambda m: _fields(m, none, dtype))
        if isinstance(dtype, T.ArrayType):
            items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _typed(x, dtype.elementType))
            return _bound(items, lambda found: _result(
                none | F.coalesce(F.forall(found, lambda x: x["ok"]), F.lit(False)), F.transform(found, lambda x: x["value"])
            ))
        kind = F.schema_of_variant(v)
        fits = kind.isin(*_KINDS[type(dtype)])
        if isinstance(dtype, T.DoubleType):
            fits = fits | kind.startswith("DECIMAL")
        return _result(none | F.coalesce(fits, F.lit(False)), F.try_variant_get(v, "$", dtype.simpleString()))

    return _bound(value, read)


def _fields(entries: Column, none: Column, schema: T.StructType) -> Column:
    def named(name: str) -> Column:
        folded = F.map_values(F.map_filter(entries, lambda key, _: F.lower(key) == name))
        return F.coalesce(F.try_element_at(entries, F.lit(name)), F.get(folded, F.lit(0)))

    found = F.struct(*[_typed(named(f.name), f.dataType).alias(f.name) for f in schema.fields])

    def joined(f: Column) -> Column:
        every = F.lit(True)
        for field in schema.fields:
            every = every & f[field.name]["ok"]
        return _result(none | (entries.isNotNull() & every), F.struct(*[f[x.name]["value"].alias(x.name) for x in schema.fields]))

    return _bound(found, joined)


def _result(ok: Column, value: Column) -> Column:
    return F.struct(ok.alias("ok"), value.alias("value"))


def envelope_ok(envelope: Column) -> Column:
    return F.coalesce(envelope.getField("ok"), F.lit(False))


def envelope_value(envelope: Column) -> Column:
    return envelope.getField("value")


def zero_filled(value: Column, schema: T.StructType) -> Column:
    """Replace absent leaves by their zero value, level by level."""
    return F.struct(
        *[_zero_leaf(value.getField(f.name), f.dataType).alias(f.name) for f in schema.fields]
    )


def _zero_leaf(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return zero_filled(value, dtype)
    if isinstance(dtype, T.ArrayType):
        empty = F.array().cast(dtype)
        filled = value
        if isinstance(dtype.elementType, T.StructType):
            filled = F.transform(value, lambda item: zero_filled(item, dtype.elementType))
        return F.coalesce(filled, empty)
    if isinstance(dtype, T.StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    return F.coalesce(value, F.lit(0).cast(dtype))
