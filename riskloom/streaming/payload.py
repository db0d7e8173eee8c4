"""Rows as one column of strings, so that a keyed operator converts a narrow frame whatever passes through it."""

from __future__ import annotations

from pyspark.sql import types as T


def packed(schema: T.StructType) -> str:
    """SQL for all columns as ``array<string>``; arrays, structs and maps as JSON, binary as base64."""
    def text(field: T.StructField) -> str:
        name = field.name.replace("`", "``")
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return f"to_json(`{name}`)"
        return f"base64(`{name}`)" if isinstance(field.dataType, T.BinaryType) else f"cast(`{name}` as string)"

    return f"array({', '.join(map(text, schema.fields))})"


def unpacked(schema: T.StructType, holder: str = "payload") -> list[str]:
    """SQL for the columns that ``packed`` made."""
    def value(number: int, field: T.StructField) -> str:
        item, kind, name = f"{holder}[{number}]", field.dataType.simpleString(), field.name.replace("`", "``")
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return f"from_json({item}, '{kind}') as `{name}`"
        return f"unbase64({item}) as `{name}`" if isinstance(field.dataType, T.BinaryType) else f"cast({item} as {kind}) as `{name}`"

    return [value(number, field) for number, field in enumerate(schema.fields)]
