"""Mixing sources to target weights by Poisson replication.

Every document is repeated ``Poisson(rate)`` times, where the rate of its source is the size that the source should
have in the mixture over the size it has. The count comes from inverting the distribution at a number hashed from
``doc_id``, a seed and a piece number, so the same document always gets the same count and no state is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

SEED = 17
#: Largest mean inverted at once; a higher mean is the sum of several independent draws.
PIECE = 16.0
#: Length of the inverted table: P(X > 64) is below 1e-18 for a mean of 16.
STEPS = 64


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts, with 52 bits."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0,
                 source: str = "source", text: str = "text") -> DataFrame:
    """``src`` (null is a source of its own), its mean repetition ``rate`` and the table that inverts it.

    Target shares are ``weights`` by source name (sources not named get 0) or, without them, in proportion to
    ``size ** alpha``. The mixture holds ``budget`` times the characters of the input. A source without any character
    cannot reach a share and gets rate 0. One row per source is written; it is as small as the list of sources.
    """
    size = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    sizes = docs.select(F.col(f"`{source}`").alias("src"), size.alias("n")).groupBy("src").agg(F.sum("n").alias("n"))
    if weights is None:
        wanted = sizes.withColumn("w", F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(alpha))).otherwise(0.0))
    else:
        wanted = sizes.withColumn("w", F.when(F.col("n") > 0, F.coalesce(
            *[F.when(F.col("src") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))).otherwise(0.0))
    wanted = written(wanted, "sources")
    all_ = wanted.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    total, mass = float(all_.n or 0), float(all_.w or 0.0)
    rate = F.when((F.col("n") > 0) & F.lit(mass > 0), F.lit(budget * total) * F.col("w") / F.lit(mass or 1.0) / F.col("n")).otherwise(0.0)
    rates = wanted.select("src", rate.alias("rate"))
    pieces, cdf = poisson_table(F.col("rate"))
    return written(rates.select("src", "rate", pieces.alias("pieces"), cdf.alias("cdf")), "rates")


def poisson_table(rate: Column) -> tuple[Column, Column]:
    """``pieces`` and the cumulative distribution ``cdf`` of one piece of a Poisson number of mean ``rate``.

    Means above :data:`PIECE` are split into equal pieces whose counts add up, since exp(-rate) would underflow.
    """
    pieces = F.greatest(F.lit(1), F.ceil(rate / PIECE).cast("int"))
    lam = rate / pieces
    first = F.exp(-lam)
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * lam / k).alias("p"),
                                F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * lam / k)).alias("cdf")))
    return pieces, table["cdf"]


def poisson_count(pieces: Column, cdf: Column, u) -> Column:
    """The distribution inverted at ``u(j)``, the uniform number of piece j, summed over the pieces."""
    draws = F.transform(F.sequence(F.lit(1), pieces), u)
    return F.aggregate(draws, F.lit(0), lambda acc, x: acc + F.aggregate(cdf, F.lit(0), lambda n, c: n + (c <= x).cast("int")))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text",
              keep: list[str] | None = None) -> DataFrame:
    """Every document ``n`` times, in a global random order; adds ``copy`` (from 1) and ``shuffle_key``.

    ``row`` has the columns ``keep``, all without it.

    The rates (one row per source) are a written table, so the planner knows their size: it broadcasts them if they are
    small and otherwise joins by shuffles that AQE splits where one source is hot. Rows that repeat a ``doc_id`` draw
    the same count; rows without an id draw by their source and text, so only equal ones draw the same. Documents whose count is 0 are not in the mixture.
    """
    own = F.md5(F.to_json(F.struct(F.col(f"`{source}`").alias("s"), F.col(f"`{text}`").alias("t"))).cast("binary"))
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("null:"), own))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), key.alias("key"), F.col(f"`{source}`").alias("s"))
    joined = row.join(rates, F.col("s").eqNullSafe(F.col("src")))
    n = poisson_count(F.col("pieces"), F.col("cdf"), lambda j: uniform(F.lit(str(seed)), F.col("key"), j.cast("string")))
    copies = joined.withColumn("n", n).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    shuffle_key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "key", F.col("copy").cast("string")))
    return copies.select("row", "rate", "copy", shuffle_key.alias("shuffle_key")).orderBy("shuffle_key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of ``docs``: what a training run reads."""
    names = {k: options[k] for k in ("source", "text") if k in options}
    return replicate(docs, source_rates(docs, **options), **names).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
