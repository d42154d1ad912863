"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bucketed, cleaned_up, discard, shared_dir, ship, written

__all__ = ["NULL_ID", "bucketed", "cleaned_up", "discard", "order_id", "parallelism", "shared_dir", "ship", "text_of", "written"]

#: What a null id counts as where ids are ordered: it comes first.
NULL_ID = -(1 << 63)


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def order_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long to order by: whole numbers as they are, other kinds by their hash, null first."""
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    value = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    return F.coalesce(value, F.lit(NULL_ID))


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
