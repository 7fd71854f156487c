"""Counts over the seconds before each row, of one key, however many rows a key has.

Time is cut into periods as long as the window. A row is counted in its own period and lent
to the next, so a period holds all rows that its own ones look back on, and a key is as many
tasks as it has periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def preceding(df: DataFrame, key: str, at: str, counted: Column, seconds: int, name: str = "n_before") -> DataFrame:
    """``df`` with how many ``counted`` rows of the same key lie in the ``seconds`` up to and with each row's own time, the row itself among them.

    Both ends are counted. Rows without a key or a time count none.
    """
    micros, span = F.unix_micros(F.col(at).cast("timestamp")), seconds * MICROS
    own = F.floor(micros / span)
    marked = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_at", micros).withColumn("_counted", F.coalesce(counted, F.lit(False)).cast("int"))
    lent = marked.withColumn("_lent", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_period", own + F.col("_lent")).where("_lent = 0 OR _counted = 1").withColumn("_place", F.col("_at") - own * span)
    # of its own period a row counts what lies no later in it, of the period before what lies no earlier: sums that only grow, so no row is looked at again
    by_place = Window.partitionBy(key, "_period").orderBy("_place")
    borrowed, here = F.when(F.col("_lent") == 1, F.col("_counted")).otherwise(0), F.when(F.col("_lent") == 0, F.col("_counted")).otherwise(0)
    upto = F.sum(here).over(by_place.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    missed = F.coalesce(F.sum(borrowed).over(by_place.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_borrowed = F.sum(borrowed).over(Window.partitionBy(key, "_period"))
    found = lent.withColumn(name, upto + all_borrowed - missed).where("_lent = 0").select(*df.columns, name)
    return found.unionByName(df.where(F.col(key).isNull() | F.col(at).isNull()).withColumn(name, F.lit(0).cast("long")))
