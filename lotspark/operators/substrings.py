"""Which needles stand in which texts, by an equi-join on pieces of letters instead of a comparison of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a piece; shorter needles are pieces themselves.
PIECE = 3


def pieces(text: Column, size: Column) -> Column:
    """Distinct pieces of a text; none of a shorter one."""
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(own)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, needles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (``by``, text, needle) where the text contains the needle and both agree in ``by``.

    ``texts``: by, text; ``needles``: by, needle. A needle stands under that piece of
    its own that the fewest texts hold, and meets these texts only; pairs are then
    tested. A needle with a piece that no text holds is in none. Empty needles and
    nulls are in nothing.
    """
    where = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    keys = list(by) or ["_all"]
    text = texts.where("text is not null").select(*where, "text").distinct().withColumn("_t", F.unhex(F.md5("text")))
    needle = needles.where("needle <> ''").select(*where, "needle").distinct().withColumn("_size", F.least(F.lit(PIECE), F.length("needle")))
    sizes = needle.groupBy(*keys).agg(F.collect_set("_size").alias("_sizes"))
    held = text.join(sizes, keys).withColumn("_size", F.explode("_sizes")).select(*keys, "_t", F.explode(pieces(F.col("text"), F.col("_size"))).alias("_piece"))
    often = held.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    own = needle.select(*keys, "needle", F.explode(pieces(F.col("needle"), F.col("_size"))).alias("_piece")).join(often, [*keys, "_piece"], "left")
    rarest = own.groupBy(*keys, "needle").agg(F.count("*").alias("_own"), F.count("_n").alias("_met"), F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece"))
    met = held.join(rarest.where("_own = _met").select(*keys, "_piece", "needle"), [*keys, "_piece"]).select(*keys, "_t", "needle")
    return met.join(text, [*keys, "_t"]).where("contains(text, needle)").select(*by, "text", "needle")
