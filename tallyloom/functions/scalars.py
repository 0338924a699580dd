"""Column helpers shared by the operators, and a few helpers on column names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.fixed_values import CURRENCY


def col(name: str) -> Column:
    """Column by exact name, also with dots, spaces or brackets in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_number(value: Column) -> Column:
    """Number, or NULL where the text is no number."""
    return value.try_cast("double")


def is_integer(value: Column) -> Column:
    """A text that is a whole number of 64 bits; NULL for NULL."""
    return value.rlike(r"^\s*[+-]?[0-9]+\s*$") & value.try_cast("bigint").isNotNull()


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def contains_any(value: Column, words: Iterable[str]) -> Column:
    """True where ``value`` contains one of ``words``."""
    found = F.lit(False)
    for word in words:
        found = found | value.contains(word)
    return found


def count_contained(value: Column, words: Iterable[str]) -> Column:
    """How many of ``words`` occur in ``value``."""
    return sum((value.contains(w).cast("int") for w in words), F.lit(0))


def any_word_pattern(words: Iterable[str], word_boundary: bool = False) -> str:
    body = "|".join(re.escape(w) for w in words)
    return rf"\b(?:{body})(?!\w)" if word_boundary else f"(?:{body})"


def is_digits(value: Column) -> Column:
    return value.rlike("^[0-9]+$")


def has_cased(value: Column) -> Column:
    return F.lower(value) != F.upper(value)


def is_lower(value: Column) -> Column:
    return has_cased(value) & (value == F.lower(value))


def is_upper(value: Column) -> Column:
    return has_cased(value) & (value == F.upper(value))


def is_title(value: Column) -> Column:
    """Upper case exactly where a run of letters starts."""
    titled = ~value.rlike(r"[\p{L}]\p{Lu}") & ~value.rlike(r"(?:^|[^\p{L}])\p{Ll}")
    return has_cased(value) & titled


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def grouped_number(value: Column) -> Column:
    """``1,234``"""
    return F.format_number(value, 0)


def money(value: Column) -> Column:
    """``RM 1,234.50``"""
    return F.concat(F.lit(f"{CURRENCY} "), F.format_number(F.coalesce(value, F.lit(0.0)), 2))


def share(part: Column, whole: Column) -> Column:
    """part / whole, NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def row_digest(columns: Iterable[Column], salt: int = 0) -> list[Column]:
    """Two 64-bit hashes of a row, NULL-safe, to group by in place of wide rows.

    Fixed-width single columns are hashed without collisions. For whole rows
    and texts the pair acts as a 128-bit digest: the chance of one collision
    among 10**12 different rows is below 10**-14. The null flags are hashed
    too, because the hash skips NULLs.
    """
    columns = list(columns)
    flags = [c.isNull() for c in columns]
    return [
        F.xxhash64(F.lit(salt + 1), *columns, *flags).alias("_h1"),
        F.xxhash64(F.lit(salt + 2), *flags, *columns).alias("_h2"),
    ]


def hashable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be hashed and compared: arrays, maps and structs as JSON."""
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(col(name)) if nested else col(name)


def value_digest(df: DataFrame, name: str) -> list[Column]:
    """Digest of one column. Fixed-width values need only the first hash, which is one-to-one for them."""
    data_type = df.schema[name].dataType
    h1, h2 = row_digest([hashable(df, name)])
    fixed_width = isinstance(data_type, (*INTEGERS, *STAMPS, T.FloatType, T.DoubleType, T.BooleanType))
    return [h1, F.lit(0).cast("bigint").alias("_h2") if fixed_width else h2]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of the left side stay."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"_key_{i}"))
    return left.join(renamed, same, how).drop(*[f"_key_{i}" for i in range(len(keys))])


# ---- types -----------------------------------------------------------------

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DECIMALS = (T.FloatType, T.DoubleType, T.DecimalType)
STAMPS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind(data_type: T.DataType) -> str:
    """integer / decimal / text / boolean / timestamp / other."""
    if isinstance(data_type, INTEGERS):
        return "integer"
    if isinstance(data_type, DECIMALS):
        return "decimal"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, STAMPS):
        return "timestamp"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, k in kinds(df).items() if k in wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "integer", "decimal")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "text")


# ---- column names ------------------------------------------------------------

def normal_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def unique_names(names: Iterable[str | None]) -> list[str]:
    """Fill missing names with ``Column_i`` and number repeats ``_1``, ``_2``.

    Names that differ only in case repeat each other, as in Spark SQL.
    """
    result: list[str] = []
    taken: set[str] = set()
    for i, name in enumerate(names):
        base = name if name not in (None, "") else f"Column_{i}"
        candidate, n = base, 0
        while candidate.lower() in taken:
            n += 1
            candidate = f"{base}_{n}"
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def name_similarity(left: str, right: str) -> float:
    """1.0 for equal names, 0.8 if one holds the other, else shared letters."""
    a, b = (re.sub(r"[_ ]", "", n.lower()) for n in (left, right))
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.8
    letters = set(a) | set(b)
    return len(set(a) & set(b)) / len(letters) if letters else 0.0


def name_similarity_column(left: Column, right: Column) -> Column:
    """The same measure on two columns of names."""
    a = F.regexp_replace(F.lower(left), "[_ ]", "")
    b = F.regexp_replace(F.lower(right), "[_ ]", "")
    letters_a, letters_b = (F.array_distinct(F.split(x, "")) for x in (a, b))
    shared = F.size(F.array_intersect(letters_a, letters_b))
    union = F.size(F.array_union(letters_a, letters_b))
    return (
        F.when(a == b, F.lit(1.0))
        .when(a.contains(b) | b.contains(a), F.lit(0.8))
        .otherwise(share(shared, union))
    )


def constant_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few driver-side facts as a frame of literals (flat types only)."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(name) for v, (name, t) in zip(row, fields)]) for row in rows
    ]
    if not structs:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(name) for name, t in fields])
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))
