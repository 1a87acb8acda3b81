"""Rules that all queries share: text matching, fractions, type filters, sort specifications and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of a type filter to the suffix of its count column.
TYPES = ("all", "nodes", "ways", "relations")
COUNTS = [f"count_{t}" for t in TYPES]
ESCAPE = "@"


def check_type(T: str) -> str:
    if T not in TYPES:
        raise ValueError(f"unknown filter {T!r}; one of {', '.join(TYPES)}")
    return T


def required(**given) -> None:
    """Raises unless every parameter has a value."""
    for name, value in given.items():
        if value is None or value == "":
            raise ValueError(f"parameter {name} is missing")


def like_escape(text: str | None) -> str:
    """A text as a LIKE pattern that matches just it."""
    return "".join(ESCAPE + c if c in "%_@" else c for c in text or "")


def like_contains(text: str | None) -> str:
    return f"%{like_escape(text)}%"


def like_prefix(text: str | None) -> str:
    return f"{like_escape(text)}%"


def fold(column: Column | str) -> Column:
    """ASCII letters in lower case; others as they are, as LIKE compares them."""
    column = F.col(column) if isinstance(column, str) else column
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _folded(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def contains(column: Column | str, text: str) -> Column:
    """Case-insensitive (ASCII) substring match."""
    return fold(column).contains(_folded(text))


def starts_with(column: Column | str, text: str) -> Column:
    return fold(column).startswith(_folded(text))


def matching(df: DataFrame, text: str | None, *columns: Column | str) -> DataFrame:
    """Rows where any of the columns contains the text; all rows without a text."""
    if not text:
        return df
    return df.where(reduce(Column.__or__, [F.coalesce(contains(c, text), F.lit(False)) for c in columns]))


def fraction(part: Column | str, whole: Column | str | int | float, digits: int | None = 4) -> Column:
    """part / whole, null where the whole is 0; rounded half up unless digits is None."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole if isinstance(whole, Column) else F.lit(whole)
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if digits is None else F.round(value, digits)


def number_prefix(column: Column | str) -> Column:
    """The number that a text starts with, else 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    found = F.regexp_extract(column, r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def sort_keys(spec: dict[str, list[str]], sort: str | None, order: str | None = "asc") -> list[Column]:
    """Columns to order by.

    ``spec`` maps each sortable name to its expressions (an empty list stands for the name itself); one with a leading
    ``!`` goes the other way round. The first name is the default.
    """
    order = (order or "asc").lower()
    if order not in ("asc", "desc"):
        raise ValueError(f"unknown sort order {order!r}")
    sort = sort or next(iter(spec))
    if sort not in spec:
        raise ValueError(f"cannot sort by {sort!r}; one of {', '.join(spec)}")
    keys = []
    for name in spec[sort] or [sort]:
        down = (order == "desc") != name.startswith("!")
        column = F.expr(name.lstrip("!"))
        keys.append(column.desc() if down else column.asc())
    return keys


def sorted_page(
    df: DataFrame,
    spec: dict[str, list[str]] | None = None,
    sort: str | None = None,
    order: str | None = "asc",
    page: int | None = None,
    rp: int | None = None,
) -> DataFrame:
    """Ordered rows, and of them one page of rp rows; all rows without paging. The remaining columns break ties, so that
    pages never overlap. Without a sort specification the rows stay unordered unless paged."""
    if (page is None) != (rp is None):
        raise ValueError("page and rp belong together")
    keys = sort_keys(spec, sort, order) if spec else []
    if page is None:
        return df.orderBy(*keys) if keys and sort else df
    if not (1 <= int(rp) <= 999 and 1 <= int(page) <= 999_999):
        raise ValueError("rp must be from 1 to 999 and page from 1 to 999999")
    plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    return df.orderBy(*keys, *plain).offset((int(page) - 1) * int(rp)).limit(int(rp))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, row: Column, name: str) -> DataFrame:
    """The first k rows of each group as a sorted array ``name`` of ``row``."""
    from pyspark.sql import Window

    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= k)
    found = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rank", row.alias("_row")))).alias("_rows"))
    return found.select(*group, F.col("_rows._row").alias(name))


def typed(column: str = "otype") -> list[Column]:
    """count_all, count_nodes, count_ways and count_relations of the rows of a group."""
    return [
        F.count("*").alias("count_all"),
        F.count_if(F.col(column) == "n").alias("count_nodes"),
        F.count_if(F.col(column) == "w").alias("count_ways"),
        F.count_if(F.col(column) == "r").alias("count_relations"),
    ]


def counters(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One aggregation as rows (key, value); nulls count as 0."""
    one = df.agg(*[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"c{i}") for i, c in enumerate(named.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"c{i}").alias("value")) for i, k in enumerate(named)])
    return one.select(F.inline(rows))
