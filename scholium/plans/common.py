"""What the queries share: deliveries counted once, and pieces of SQL for their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T


def once(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """The first loaded row of each key, of ties the least by its fields."""
    row = F.struct("loaded_at", *fields)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("r")).select(key, *[F.col(f"r.{f}").alias(f) for f in fields])


def sql_once(table: str, key: str, *fields: str) -> str:
    order = ", ".join(f"{f} NULLS FIRST" for f in ("loaded_at", *fields))
    cols = ", ".join([key, *fields])
    return f"(SELECT {cols} FROM (SELECT {cols}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {table} WHERE {key} IS NOT NULL) WHERE rn = 1)"


CJK = "[㐀-䶿一-鿿]"


def sql_bare(x: str) -> str:
    return f"translate(regexp_replace({x}, '[\\x{{300}}-\\x{{36F}}]', '', 'g'), '{T.ACCENTED}', '{T.BARE}')"


def sql_tokens(x: str) -> str:
    plain = f"regexp_replace(lower(coalesce({x}, '')), '{CJK}', ' ', 'g')"
    return f"regexp_extract_all({sql_bare(plain)}, '[\\p{{L}}\\p{{N}}]+')"


def sql_search_form(x: str) -> str:
    narrow = f"translate(coalesce({x}, ''), '{T.WIDE.replace(chr(39), chr(39) * 2)}', '{T.NARROW.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace(regexp_replace({sql_bare(f'lower({narrow})')}, '[‐-―]', '-', 'g'), '\\s+', ' ', 'g'))"


def sql_grams(x: str, least: int = 1, most: int = 2) -> str:
    parts = " || ".join(f"list_transform(range(1, length(r) - {n - 2}), lambda i: substring(r, i, {n}))" for n in range(least, most + 1))
    return f"flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '{CJK}+'), lambda r: {parts}))"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def sql_in(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"
