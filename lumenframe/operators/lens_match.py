"""Ranked matching of lens names as bodies write them against a table of lenses.

A name is a set of tokens, words and numbers. Two names are compared only if one's tokens, or its numbers, may all be in the
other's: each side then names its rarest token, and the pair meets there. So a token that a third of all lenses carry makes
no pairs, unless it is the rarest one of a name. Nine criteria rank what has met, compared in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of a stabiliser, and of a focus motor, in lens names.
STABILISERS = ["is", "os", "oss", "ois", "vr", "vc"]
MOTORS = ["usm", "stm", "hsm", "swm", "ssm", "sdm"]

#: The criteria in their order, with the number of values that each can take.
CRITERIA = {"name": 6, "format": 3, "mount": 2, "brand": 3, "range": 3, "aperture": 3, "stabiliser": 3, "motor": 3, "closeness": 10}
NUMERIC = "^[0-9]"


def tokens(text: str) -> Column:
    """Words and numbers of a name in lower case; ``70-200mm f/2.8`` has 70, 200, mm, f and 2.8."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def _sides(asked: DataFrame, lenses: DataFrame) -> tuple[DataFrame, DataFrame]:
    of = lambda df, name: df.withColumn("words", tokens(name)).withColumn("set", F.array_distinct("words")).withColumn("numbers", F.filter("set", lambda t: t.rlike(NUMERIC)))
    return of(asked, "text"), of(lenses, "model")


def candidates(asked: DataFrame, lenses: DataFrame) -> DataFrame:
    """(ask_id, lens_id), each pair once: those of which one's tokens, or numbers, may all be among the other's."""
    listed = lambda df, key: df.select(key, F.explode("set").alias("token"))
    # Each join is of tables that grow with the lenses: their shuffled bytes may look small, and the driver fills if it gathers them for a broadcast.
    asks, held = listed(asked, "ask_id"), listed(lenses, "lens_id")
    often = held.groupBy("token").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, key: str) -> DataFrame:
        counted = df.join(often.hint("merge"), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        least = F.min(F.struct("n", "token"))
        number = F.min(F.when(F.col("token").rlike(NUMERIC), F.struct("n", "token")))
        keys = counted.groupBy(key).agg(F.array(least, number).alias("keys"))
        return keys.select(key, F.explode(F.array_distinct("keys")).alias("k")).where("k is not null").select(key, "k.token")

    met = rarest(asks, "ask_id").join(held.hint("merge"), "token").unionByName(asks.join(rarest(held, "lens_id").hint("merge"), "token"))
    return met.select("ask_id", "lens_id").distinct()


def _within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _marks(words: Column, known: list[str]) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, known)))


def name_tier(asked: str = "a", lens: str = "l") -> Column:
    """5 the same name, 4 all tokens asked for are the lens's, 3 all the lens's are asked for, 2 and 1 likewise of the numbers alone, 0 none of these."""
    a, b = (lambda c: F.col(f"{asked}.{c}")), (lambda c: F.col(f"{lens}.{c}"))
    some = lambda c: F.size(c) > 0
    tier = F.when((a("words") == b("words")) & some(a("words")), 5).when(some(a("set")) & _within(a("set"), b("set")), 4).when(some(b("set")) & _within(b("set"), a("set")), 3)
    return tier.when(some(a("numbers")) & _within(a("numbers"), b("numbers")), 2).when(some(b("numbers")) & _within(b("numbers"), a("numbers")), 1).otherwise(0)


def criteria(adapted: bool = False) -> dict[str, Column]:
    """The nine criteria of a pair of ``a`` (what is asked for, with its body) and ``l`` (a lens). ``adapted``: mounts say nothing."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"l.{c}"))
    unknown = lambda *cs: [c.isNull() for c in cs]
    any_of = lambda conditions: F.greatest(*conditions) if len(conditions) > 1 else conditions[0]

    def marks(known: list[str]) -> Column:
        want, has = _marks(a("set"), known), _marks(b("set"), known)
        return F.when(_within(want, has) & _within(has, want), 2).when(_within(has, want), 1).otherwise(0)

    near = F.least(a("crop"), b("crop")) / F.greatest(a("crop"), b("crop"))
    maker = F.lower(b("maker"))
    return {
        "name": name_tier(),
        "format": F.when(any_of(unknown(a("crop"), b("crop"))), 1).when(F.abs(a("crop") - b("crop")) < 0.05, 2).when(b("crop") < a("crop"), 1).otherwise(0),
        "mount": F.lit(0) if adapted else F.coalesce((a("mount") == b("mount")).cast("int"), F.lit(0)),
        "brand": F.when(maker == F.lower(a("maker")), 2).when(maker == F.lower(a("body_maker")), 1).otherwise(0),
        "range": F.when(any_of(unknown(a("focal"), b("focal_low"))), 1).when(a("focal").between(b("focal_low"), F.coalesce(b("focal_high"), b("focal_low"))), 2).otherwise(0),
        "aperture": F.when(any_of(unknown(a("aperture"), b("aperture"))), 1).when(F.abs(a("aperture") - b("aperture")) < 0.05, 2).otherwise(0),
        "stabiliser": marks(STABILISERS),
        "motor": marks(MOTORS),
        "closeness": F.coalesce(F.floor(near * 9), F.lit(0)),
    }


def rank_lenses(asked: DataFrame, lenses: DataFrame, most: int, adapted: bool = False) -> DataFrame:
    """ask_id, place (1 to ``most``), lens_id, the nine criteria, total (them as one number) and sure.

    ``asked``: ask_id, text, maker, body_maker, crop, mount, focal, aperture; ``lenses``: lens_id, model, maker, crop, mount,
    focal_low, focal_high, aperture; null is unknown. Pairs of tier 0 are no candidates. Equal totals rank by lens_id. A
    match is sure if the tier is 3 or more and all numbers asked for, one at least, are the lens's.
    """
    asked, lenses = _sides(asked, lenses)
    pairs = candidates(asked, lenses)
    met = pairs.join(asked.select("ask_id", F.struct(*asked.columns).alias("a")).hint("merge"), "ask_id").join(lenses.select("lens_id", F.struct(*lenses.columns).alias("l")).hint("merge"), "lens_id")
    scored = met.select("ask_id", "lens_id", *[c.cast("int").alias(n) for n, c in criteria(adapted).items()], ((F.size("a.numbers") > 0) & _within(F.col("a.numbers"), F.col("l.numbers"))).alias("numbers"))
    total = F.lit(0).cast("long")
    for name, values in CRITERIA.items():
        total = total * values + F.col(name)
    scored = scored.where("name > 0").withColumn("total", total).withColumn("sure", (F.col("name") >= 3) & F.col("numbers")).drop("numbers")
    # Spark keeps the first ``most`` of each task before it shuffles.
    place = F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("total"), "lens_id"))
    return scored.withColumn("place", place).where(F.col("place") <= most)
