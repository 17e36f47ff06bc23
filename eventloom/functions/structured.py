"""JSON and XML members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_json(c: Column | str, schema: str | T.StructType) -> Column:
    """A nested record of the given schema; all numbers are read as double where the schema says so."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, schema)


def decode_json_free(c: Column | str) -> Column:
    """A VARIANT of any JSON; NULL if it is none."""
    return F.try_parse_json(F.col(c) if isinstance(c, str) else c)


def json_number(c: Column | str, path: str) -> Column:
    return F.get_json_object(F.col(c) if isinstance(c, str) else c, path).try_cast("double")


def json_array(df: DataFrame, member: str, path: str, name: str) -> DataFrame:
    """One row for each element of an array in a JSON member: name_I with its place, name with its JSON text."""
    items = F.from_json(F.get_json_object(member, path), "array<string>")
    return df.select("*", F.posexplode(items).alias(f"{name}_I", name))


def to_json(members: list[str], typed: bool = False) -> Column:
    """A record as JSON: every scalar as a string (or by type), arrays as arrays, bytes in hexadecimal; absent members are left out."""
    return F.to_json(F.struct(*[F.col(m).alias(m.split(".")[-1]) for m in members])) if typed else F.to_json(F.struct(*[_quoted(F.col(m), m).alias(m.split(".")[-1]) for m in members]))


def _quoted(c: Column, name: str) -> Column:
    return c.cast("string")


def quoted_json(df: DataFrame, members: list[str], name: str = "JSON") -> DataFrame:
    """``to_json`` that knows the members' types: nested records and arrays keep their shape, scalars are quoted."""

    def one(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*[one(c.getField(f.name), f.dataType).alias(f.name) for f in t])
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: one(x, t.elementType))
        if isinstance(t, T.BinaryType):
            return F.hex(c)
        return c.cast("string")

    return df.withColumn(name, F.to_json(F.struct(*[one(F.col(m), df.schema[m].dataType).alias(m) for m in members])))


def one_document(df: DataFrame, members: list[str], most: int = 1_000_000) -> DataFrame:
    """A single row with a JSON array of all records, every value a string. For at most ``most`` records, as the array is one value; more raise an error."""
    rows = df.select(F.struct(*[F.col(m).cast("string").alias(m) for m in members]).alias("r")).limit(most + 1)
    too_many = F.raise_error(F.lit(f"more than {most} records in one document"))
    return rows.agg(F.collect_list("r").alias("all")).select(F.when(F.size("all") > most, too_many).otherwise(F.to_json("all")).alias("json"))


def parse_xml(c: Column | str, paths: dict[str, str]) -> list[Column]:
    """The text at each XPath, NULL where there is none; name -> path."""
    c = F.col(c) if isinstance(c, str) else c
    return [F.nullif(F.trim(F.xpath_string(c, F.lit(p))), F.lit("")).alias(n) for n, p in paths.items()]


def parse_xml_record(c: Column | str, schema: str) -> Column:
    """A nested record: elements as members, attributes as ``_name``."""
    return F.from_xml(F.col(c) if isinstance(c, str) else c, schema)


def named_data(c: Column | str, names: list[str], element: str = "Data", attribute: str = "Name") -> list[Column]:
    """``<Data Name="X">text</Data>`` as member X."""
    return parse_xml(c, {n: f"//{element}[@{attribute}='{n}']" for n in names})
