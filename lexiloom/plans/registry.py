"""Where queries and their SQL are registered, and pieces of SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(d: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt out by keys: a table of one file or one row group is read in one task, which must not do all the work."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_PLAIN = r"""trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '''', ''),
 '([0-9])\.([0-9])', '\1<dot>\2', 'g'), '([a-z0-9])/([a-z0-9])', '\1<sl>\2', 'g'), '([a-z0-9]):([a-z0-9])', '\1<co>\2', 'g'), '[^a-z0-9%+<>]+', ' ', 'g'),
 '<dot>', '.'), '<sl>', '/'), '<co>', ':'), '[<> ]+', ' ', 'g'))"""


def plain(col: str) -> str:
    """normalize_ascii in SQL."""
    return _PLAIN.format(col)


def toks(col: str) -> str:
    return f"list_filter(string_split({plain(col)}, ' '), lambda x: x <> '')"


def sound_sql(s: str) -> str:
    """phonetic_key without look-ahead and back-references."""
    x = f"replace(replace(replace(replace(replace({s}, 'ph', 'f'), 'x', 'ks'), 'ck', 'k'), 'ch', '#'), 'c', 'k')"
    x = f"replace(replace(replace(replace(replace(replace({x}, '#', 'ch'), 'q', 'k'), 'w', 'v'), 'v', 'b'), 'z', 'j'), ' ', '')"
    x = f"regexp_replace({x}, '([kgcjtdpb])h', '\\1', 'g')"
    x = f"replace(replace(replace(replace(replace(replace({x}, 'ee', 'i'), 'ii', 'i'), 'oo', 'u'), 'uu', 'u'), 'aa', 'a'), 'y', 'i')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x
