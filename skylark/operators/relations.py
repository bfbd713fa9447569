"""Links between the actors of one signal: the first verb pattern that its words meet says how, the actors' own confidence how surely."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (pattern, relation, weight); of several patterns in a text the first in this order counts.
PATTERNS = (
    (r"\barrested?|charged?|detained", "INVESTIGATED_BY", 0.65),
    (r"\braid|swoops?|search", "INVESTIGATED_BY", 0.55),
    (r"\binvestigat", "INVESTIGATED_BY", 0.50),
    (r"\bprosecuted?|convicted?|sentenced?", "INVESTIGATED_BY", 0.70),
    (r"\bleads?|heads?|commands?|appointed", "LEADS", 0.60),
    (r"\bceo|minister|director general", "LEADS", 0.60),
    (r"\bemploy|works? (?:at|for)|staff\b", "EMPLOYED_BY", 0.50),
    (r"\bmember|official|represent", "AFFILIATED_WITH", 0.40),
    (r"\bcontract|tender|procure|award", "CONTRACTED", 0.55),
    (r"\bpays?|funds?|finances?", "FUNDED_BY", 0.45),
    (r"\ballied?|coalition|partner", "ALLIED_WITH", 0.45),
    (r"\bopposed?|critic|challenged?", "OPPOSED_TO", 0.45),
    (r"\bkilled?|murder|assassinat|shot\b", "TARGETED_BY", 0.70),
    (r"\battacked?|threatened?", "TARGETED_BY", 0.55),
)
# Parts of the names of those who enforce the law, who are the object of this relation.
ENFORCERS = ("investigat", "police", "hawk", "npa", "siu", "saps")
ORIENTED = "INVESTIGATED_BY"


def verb_links(signals: DataFrame, actors: DataFrame, patterns: Sequence = PATTERNS, enforcers: Iterable[str] = ENFORCERS, *, oriented: str = ORIENTED, noise: Iterable[str] = (), least_actor: float = 0.3, least: float = 0.15, head: int = 300) -> DataFrame:
    """(subject, object, relation, confidence, signal_id): one row per subject, object and relation, that of the first signal in order of its id.

    signals (signal_id, title, content), actors (signal_id, actor_id, name, confidence). The title and the first `head` characters are read. A pair's confidence is the lower of its two, times the pattern's weight;
    the smaller id is the subject, except that of one enforcer and one other the other is, in the oriented relation. Null titles and contents are empty, a null confidence or name keeps an actor out.
    """
    words = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce(F.substring("content", 1, head), F.lit("")))
    first = F.coalesce(*[F.when(words.rlike("(?iU)" + p), F.struct(F.lit(r).alias("relation"), F.lit(float(w)).alias("weight"))) for p, r, w in patterns])
    said = signals.select("signal_id", first.alias("f")).where("f is not null").select("signal_id", "f.relation", "f.weight")
    low = F.lower("name")
    force = F.lit(False)
    for part in enforcers:
        force = force | low.contains(part)
    known = actors.where((F.col("confidence") >= least_actor) & ~F.trim(low).isin(*noise) if noise else (F.col("confidence") >= least_actor) & low.isNotNull())
    known = known.select("signal_id", "actor_id", "confidence", force.alias("force")).dropDuplicates(["signal_id", "actor_id"])
    # Signals without a verb go before any pair is made.
    told = known.join(said, "signal_id")
    a = told.select("signal_id", "relation", "weight", F.col("actor_id").alias("a"), F.col("confidence").alias("ca"), F.col("force").alias("fa"))
    b = told.select("signal_id", F.col("actor_id").alias("b"), F.col("confidence").alias("cb"), F.col("force").alias("fb"))
    pairs = a.join(b, "signal_id").where("a < b").withColumn("confidence", F.round(F.least("ca", "cb") * F.col("weight"), 4)).where(F.col("confidence") >= least)
    turned = (F.col("relation") == oriented) & F.col("fa") & ~F.col("fb")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    found = pairs.select(pick("a", "b").alias("subject"), pick("b", "a").alias("object"), "relation", "confidence", "signal_id")
    best = found.groupBy("subject", "object", "relation").agg(F.min_by(F.struct("confidence", "signal_id"), "signal_id").alias("m"))
    return best.select("subject", "object", "relation", "m.confidence", "m.signal_id")
