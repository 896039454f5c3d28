"""Attribute-value rows into one wide row per entity, by blocks of columns.

The attributes are cut into blocks.  One scan writes the rows of the listed predicates to a folder for each block.  Each
block is pivoted by itself from its folder: conditional minima, combined map-side and then hash-partitioned by the entity
into one number of partitions.  All blocks have identical partitioning, so joining them moves nothing.  A block's width
bounds the aggregation buffer; thousands of attributes are many blocks, but one scan.

Values are parsed by type.  Defined cases: NULL entity, predicate or object rows fill nothing; an entity without a
valid value in any attribute has a row of NULLs; of several valid values the smallest counts (ties are equal values);
decimals are exact at any number of digits and rounded once, half up, to two places; one that is written with an
exponent is valid if it is less than 1e309; typed numbers that their Spark type cannot hold are NULL, or texts in the
map column that ``beyond`` names; years before 0001 are no real dates; predicates that are
not listed, and extra columns, are ignored; a predicate listed twice fills both columns; predicates that fill one column
must have one type (ValueError).  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import literal_text
from ..runtime import new_path


@dataclass(frozen=True)
class Attribute:
    predicate: str
    column: str
    type: str


def _big_integer(text: Column) -> Column:
    """Integers of any length in numeric order: sign, number of digits, digits (complemented when negative)."""
    negative = text.startswith("-")
    digits = F.regexp_replace(text, r"^[+-]?0*(?=\d)", "")
    negative = negative & (digits != "0")
    return F.struct(
        F.when(negative, -F.length(digits)).otherwise(F.length(digits)).alias("size"),
        F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"),
        F.when(negative, F.concat(F.lit("-"), digits)).otherwise(digits).alias("val"),
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), then)[0]


def _cents(text: Column) -> Column:
    """A valid decimal rounded half up to two places, as text, from its digits; NULL if its exponent is out of range."""
    whole, fraction, power = (F.regexp_extract(text, r, 1) for r in (r"^[+-]?([0-9]+)", r"\.([0-9]+)", r"[eE]([+-]?[0-9]+)\z"))
    far = F.when(power.startswith("-"), F.lit(-(1 << 40))).otherwise(F.lit(1 << 40))
    shift = F.when(power == "", F.lit(0)).otherwise(F.coalesce(power.try_cast("bigint"), far))
    shift = F.greatest(F.least(shift, F.lit(1 << 40)), F.lit(-(1 << 40)))

    def rounded(x: Column) -> Column:  # x: digits, how many of them are cents, the digits without leading zeros
        size = F.greatest(x["size"], F.lit(0)).cast("int")
        head = F.rpad(F.substring(x["digits"], F.lit(1), size), size, F.lit("0"))
        up = (x["size"] >= 0) & (F.substring(x["digits"], size + 1, F.lit(1)) >= "5")
        return F.when(up, _let(head, _plus_one)).otherwise(head)

    def placed(cents: Column) -> Column:
        least = F.lpad(cents, F.greatest(F.length(cents), F.lit(3)), F.lit("0"))
        sign = F.when(text.startswith("-") & (cents != ""), "-").otherwise("")
        return F.concat(sign, F.left(least, F.length(least) - 2), F.lit("."), F.right(least, F.lit(2)))

    def judged(x: Column) -> Column:
        zeros = F.length(x["digits"]) - F.length(x["rest"])
        fits = (power == "") | (x["size"] - 2 - zeros <= 309)
        value = F.when(fits, _let(F.regexp_replace(rounded(x), "^0+", ""), placed))
        return F.when(x["rest"] == "", F.lit("0.00")).otherwise(value)

    digits = F.concat(whole, fraction)
    return _let(F.struct(digits.alias("digits"), (F.length(whole) + shift + 2).alias("size"), F.regexp_replace(digits, "^0+", "").alias("rest")), judged)


def _plus_one(digits: Column) -> Column:
    rest = F.regexp_replace(digits, r"9+\z", "")
    last = F.coalesce(F.right(rest, F.lit(1)).try_cast("int"), F.lit(0)) + 1
    return F.concat(F.left(rest, F.greatest(F.length(rest) - 1, F.lit(0))), last.cast("string"), F.repeat(F.lit("0"), F.length(digits) - F.length(rest)))


def parsed(o: Column, type: str) -> Column:
    """A struct that orders by value and has the value's text as ``val``; NULL if ``o`` is not valid for the type."""
    text = F.trim(literal_text(o))
    if type == "iri":
        value = F.substring(o, F.lit(2), F.length(o) - 2)
        return F.when(o.startswith("<") & ~o.startswith("<<") & o.endswith(">"), F.struct(value.alias("val")))
    if type == "string":
        return F.when(text != "", F.struct(text.alias("val")))
    if type == "int":
        return F.when(text.rlike(r"^[+-]?[0-9]+\z"), _big_integer(text))
    if type == "decimal":
        small = text.rlike(r"^[+-]?[0-9]{1,27}(\.[0-9]{1,10})?\z")  # exact as DECIMAL(38,10)
        exact = F.when(small, text.try_cast("decimal(38,10)").cast("decimal(38,2)").cast("string"))
        exact = exact.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), _cents(text))
        return _let(exact, lambda x: F.when(x.isNotNull(), _big_integer(F.replace(x, F.lit("."), F.lit(""))).withField("val", x)))
    if type == "date":
        day = F.when(text.rlike(r"(?s)^[0-9]{4}-[0-9]{2}-[0-9]{2}(T.*)?\z") & ~text.startswith("0000"), F.left(text, F.lit(10)).try_cast("date"))
        return F.when(day.isNotNull(), F.struct(day.alias("day"), F.left(text, F.lit(10)).alias("val")))
    if type == "boolean":
        word = F.lower(text)
        truth = F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)
        return F.when(truth.isNotNull(), F.struct(truth.alias("truth"), truth.cast("string").alias("val")))
    if type == "year":
        return F.when(text.rlike(r"^[0-9]{4}\z"), F.struct(text.cast("int").alias("year"), text.cast("int").cast("string").alias("val")))
    raise ValueError(f"unknown type {type}")


# Spark types of the wide table's columns.
SPARK_TYPES = {"string": "string", "iri": "string", "int": "decimal(38,0)", "decimal": "decimal(38,2)", "date": "date", "boolean": "boolean", "year": "int"}


def column_types(attributes: list[Attribute]) -> dict[str, str]:
    """The type of each column; predicates of different types in one column are an error, as they have no common order."""
    types: dict[str, str] = {}
    for a in attributes:
        if types.setdefault(a.column, a.type) != a.type:
            raise ValueError(f"column {a.column!r} is filled by predicates of the types {types[a.column]} and {a.type}")
        if a.type not in SPARK_TYPES:
            raise ValueError(f"unknown type {a.type}")
    return types


def in_blocks(triples: DataFrame, attributes: list[Attribute], block: int) -> tuple[DataFrame, list[list[str]]]:
    """The rows of the listed predicates, written once in a folder for each block of columns, and the blocks' columns.

    ``triples`` is read once.  A predicate of several blocks is written to each of them.
    """
    columns = list(dict.fromkeys(a.column for a in attributes))
    blocks = [columns[k : k + block] for k in range(0, len(columns), block)]
    of = {c: k for k, part in enumerate(blocks) for c in part}
    where: dict[str, set[int]] = {}
    for a in attributes:
        where.setdefault(a.predicate, set()).add(of[a.column])
    places = F.create_map(*[F.lit(x) for p, ks in where.items() for x in (p, sorted(ks))])
    rows = triples.where(F.col("p").isin(list(where)) & F.col("s").isNotNull() & F.col("o").isNotNull())
    path = new_path(triples.sparkSession, "blocks")
    rows.select("s", "p", "o", F.explode(places[F.col("p")]).alias("block")).write.partitionBy("block").parquet(path)
    return triples.sparkSession.read.schema("s string, p string, o string, block int").parquet(path), blocks


def pivot_blocks(triples: DataFrame, entities: DataFrame, attributes: list[Attribute], block: int = 64, typed: bool = True, beyond: str | None = None) -> DataFrame:
    """One row per distinct ``entities.s`` with one column per attribute; ``typed`` casts the values' texts.

    ``block`` is the number of columns pivoted together.  ``beyond`` names a further column: a map of the texts that the
    columns' types cannot hold.
    """
    types = {c: SPARK_TYPES[t] for c, t in column_types(attributes).items()}
    columns = list(types)
    wide = entities.where("s IS NOT NULL").select("s").distinct()
    rows, blocks = in_blocks(triples, attributes, block) if attributes else (None, [])
    for k, names in enumerate(blocks):
        cells = []
        for c in names:
            mine = [a for a in attributes if a.column == c]
            value = F.when(F.col("p").isin([a.predicate for a in mine]), parsed(F.col("o"), mine[0].type))
            cells.append(F.min(value)["val"].alias(c))
        wide = wide.join(rows.where(F.col("block") == k).groupBy("s").agg(*cells), "s", "left")
    if not typed:
        return wide
    typed_columns = [F.col(c).try_cast(types[c]).alias(c) for c in columns]
    if beyond is None:
        return wide.select("s", *typed_columns)
    lost = F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull(), F.struct(F.lit(c).alias("attr"), F.col(c).alias("val"))) for c in columns if types[c] != "string"])
    lost = F.map_from_entries(F.array_compact(lost)) if any(types[c] != "string" for c in columns) else F.create_map().cast("map<string,string>")
    return wide.select("s", *typed_columns, lost.alias(beyond))


def cells(wide: DataFrame, columns: list[str]) -> DataFrame:
    """The filled cells of a wide table of texts as rows (s, attr, val)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"`{c}`").alias("val")) for c in columns])
    return wide.select("s", F.inline(pairs)).where("val IS NOT NULL")
