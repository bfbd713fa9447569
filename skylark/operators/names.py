"""Joins on names: mentions in texts, fuzzy resolution, names within names. All are equi-joins on words or character runs, with an exact check behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skylark.functions.align import jaro_winkler, jaro_winkler_exact
from skylark.functions.text import normal_name
from skylark.operators import automaton
from skylark.session import checkpointed

WORD = r"[\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def known_runs(names: DataFrame) -> DataFrame:
    """(run, n, name_id): the names' words, joined by blanks; of names of equal words the least id."""
    known = names.select("name_id", words_of(F.col("name")).alias("w")).where(F.size("w") > 0)
    return known.groupBy(F.array_join("w", " ").alias("run"), F.size("w").alias("n")).agg(F.min("name_id").alias("name_id"))


def mentions(docs: DataFrame, names: DataFrame, most: int = automaton.MOST_PATTERNS) -> DataFrame:
    """(doc_id, place, name_id): names (name_id, name) at whole words of texts (doc_id, text), case aside; place counts words from 0.

    The leftmost name is taken first, of those that begin there the longest, and no word belongs to two. Names of equal words count by their least id; those without a word are never met.
    Up to `most` names are an automaton that walks each text where it is read; more are joined with the runs of the texts' words.
    """
    known = known_runs(names)
    few = known.limit(most + 1).collect()
    if len(few) > most:
        return mentions_by_join(docs, known)
    few.sort()
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("_text"))
    found = automaton.hits(texts, F.col("_text"), [automaton.as_words(r.run.split(" ")) for r in few])
    table = docs.sparkSession.createDataFrame([(k, r.name_id) for k, r in enumerate(few)], StructType([StructField("pattern", IntegerType()), StructField("name_id", names.schema["name_id"].dataType)]))
    return found.select("doc_id", "hit.place", "hit.pattern").join(F.broadcast(table), "pattern").select("doc_id", "place", "name_id")


def mentions_by_join(docs: DataFrame, known: DataFrame) -> DataFrame:
    """As `mentions`: runs of as many words as some name has are joined with the names' words, so that the work follows the texts' length and not the number of names."""
    sizes = [r.n for r in known.select("n").distinct().orderBy("n").collect()]  # as many numbers as there are lengths of names
    words = docs.where(F.col("text").isNotNull()).select("doc_id", words_of(F.col("text")).alias("w"))
    place = words.select("doc_id", F.posexplode("w").alias("place", "word"))
    runs = None
    along = Window.partitionBy("doc_id").orderBy("place")
    for n in sizes:
        # A text's words are rows; a run is a word and those after it.
        run = F.concat_ws(" ", F.col("word"), *[F.lead("word", k).over(along) for k in range(1, n)])
        part = place.select("doc_id", "place", run.alias("run"), F.lit(n).alias("n"), *([F.lead("word", n - 1).over(along).alias("_last")] if n > 1 else [F.col("word").alias("_last")])).where(F.col("_last").isNotNull()).drop("_last")
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        return place.select("doc_id", "place", F.lit(None).cast(known.schema["name_id"].dataType).alias("name_id")).limit(0)
    met = runs.join(known, ["run", "n"]).groupBy("doc_id", "place").agg(F.max_by(F.struct("n", "name_id"), "n").alias("m"))
    hits = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "m.n", "m.name_id"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(hits.schema["hits"].dataType).alias("kept"))
    step = lambda s, h: F.when(h["place"] >= s["end"], F.struct((h["place"] + h["n"]).alias("end"), F.concat(s["kept"], F.array(h)).alias("kept"))).otherwise(s)
    kept = hits.select("doc_id", F.explode(F.aggregate("hits", start, step, lambda s: s["kept"])).alias("h"))
    return kept.select("doc_id", F.col("h.place").alias("place"), F.col("h.name_id").alias("name_id"))


def resolved(queries: DataFrame, actors: DataFrame, least: float = 0.92, shortest: int = 5) -> DataFrame:
    """(query_id, actor_id, how, score): the actor of a name, if any: the same but for case; else the same normalised; else the most alike by Jaro-Winkler among those with a word in common.

    An initial and an equal surname count as 0.95. Ties go to the least id. Distinct names are compared, not rows; a pair whose lengths alone keep the similarity under the
    threshold is never made: Jaro-Winkler of at least t needs a shorter name of (3 * (t - 0.4) / 0.6 - 2) times the longer one's length or more.
    """
    q = queries.select("query_id", F.lower(F.trim("name")).alias("raw"), normal_name(F.col("name")).alias("norm")).where("raw <> ''")
    a = actors.select("actor_id", F.lower(F.trim("name")).alias("raw"), normal_name(F.col("name")).alias("norm")).where("raw <> ''")
    exact = q.join(a.groupBy("raw").agg(F.min("actor_id").alias("actor_id")), "raw").select("query_id", "actor_id", F.lit("exact").alias("how"), F.lit(1.0).alias("score"))
    rest = q.join(exact.select("query_id"), "query_id", "left_anti").where("norm <> ''")
    by_norm = a.where("norm <> ''").groupBy("norm").agg(F.min("actor_id").alias("actor_id"))
    same = rest.join(by_norm, "norm").select("query_id", "actor_id", F.lit("normal").alias("how"), F.lit(1.0).alias("score"))
    open_ = rest.join(same.select("query_id"), "query_id", "left_anti").where(F.char_length("norm") >= shortest)
    ratio = 3 * (least - 0.4) / 0.6 - 2
    left = blocks(open_.select("norm").distinct(), "x")
    right = blocks(by_norm.select("norm"), "y")
    initial = (F.size("wx") >= 2) & (F.char_length(F.get("wx", F.lit(0))) <= 2)
    size = lambda c: F.char_length(c)
    pairs = left.join(right, "block").where(initial | (F.least(size("x"), size("y")) >= ratio * F.greatest(size("x"), size("y")) - 1e-9)).dropDuplicates(["x", "y"])
    last = lambda w: F.element_at(w, -1)
    scored = pairs.withColumns({"s": jaro_winkler_exact("x", "y"), "t": F.when(initial, jaro_winkler_exact(last("wx"), last("wy")))})
    short = initial & (F.col("t") >= 0.98) & F.get("wy", F.lit(0)).startswith(F.substring(F.get("wx", F.lit(0)), 1, 1))
    scored = scored.withColumn("score", F.when(short, F.greatest("s", F.lit(0.95))).otherwise(F.col("s"))).where(F.col("score") >= least)
    best = scored.join(by_norm.withColumnRenamed("norm", "y"), "y").groupBy("x").agg(F.min_by(F.struct("actor_id", "score"), F.struct(-F.col("score"), "actor_id")).alias("b"))
    fuzzy = open_.join(best.withColumnRenamed("x", "norm"), "norm").select("query_id", F.col("b.actor_id").alias("actor_id"), F.lit("fuzzy").alias("how"), F.col("b.score").alias("score"))
    return exact.unionByName(same).unionByName(fuzzy)


def unmatched(a: int, b: int, least: float) -> int:
    """How many characters of names of these lengths may lack a partner at a Jaro-Winkler similarity of `least`; -1 if the lengths alone rule it out."""
    need, m = 3 * (least - 0.4) / 0.6 - 1, min(a, b)
    if m / a + m / b < need - 1e-9:
        return -1
    while m > 0 and (m - 1) / a + (m - 1) / b >= need - 1e-9:
        m -= 1
    return a + b - 2 * m


def unequal(n: int, least: float) -> int:
    """In how many places two names of this length that agree in all characters may differ at a Jaro-Winkler similarity of `least`: every character has its partner, so that twice the transpositions, and one left over, do."""
    t = 0
    while t < n and (2 + (n - t - 1) / n) / 3 >= (least - 0.4) / 0.6 - 1e-9:
        t += 1
    return min(n, 2 * t + 1)


def alike(names: DataFrame, least: float = 0.98) -> DataFrame:
    """(a, b, similarity) for a < b: all names (id, norm) alike by Jaro-Winkler. Names are distinct; for empty ones there is no pair."""
    scored = made_pairs(names, least).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), jaro_winkler(F.col("l.norm"), F.col("r.norm")).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def made_pairs(names: DataFrame, least: float = 0.98) -> DataFrame:
    """(l, r) of names (id, norm) with l.id < r.id, each pair once: all that can be alike by Jaro-Winkler.

    For each two lengths it is known how many characters, d, may lack a partner. With the alphabet dealt into d + 1 classes, all characters of at least one class agree, so that
    these, sorted, are the key of an equi-join: no pair is missed, whatever words the names have. Where none may lack a partner, the names also have all but u of their places in common; with the places
    dealt into u + 2 lots at least two of these agree and go into the key, so that names of the same digits in another order don't all meet. A pair is made under the first key that it shares only. Work
    follows the number of names that agree in a key; the nearer `least` is to one, the more characters that is, and at 0.98 names of equal lengths under 20 agree in all of them.
    """
    held = names.where("norm <> ''").select(F.struct("id", "norm").alias("p"), F.char_length("norm").alias("n"), F.split("norm", "").alias("c"))
    lengths = sorted(r.n for r in held.select("n").distinct().collect())  # as many numbers as there are lengths of names
    two = [(a, b, unmatched(a, b, least) + 1) for a in lengths for b in lengths if a <= b and unmatched(a, b, least) >= 0]
    lots = held.sparkSession.createDataFrame([(a, b, k) for a, b, k in two if k > 1], "x int, y int, k int")
    places: dict[int, list[int]] = {}
    for a, _, k in two:
        if k == 1:
            places.setdefault(unequal(a, least) + 2, []).append(a)

    def keys(side: str, as_: str) -> DataFrame:
        x = held.join(F.broadcast(lots), F.col("n") == F.col(side)).select("p", "c", "x", "y", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
        key = F.array_join(F.array_sort(F.filter("c", lambda c: F.pmod(F.ascii(c), F.col("k")) == F.col("i"))), "")
        return x.select(F.col("p").alias(as_), "x", "y", "i", key.alias("key"))

    met = keys("x", "l").join(keys("y", "r"), ["x", "y", "i", "key"]).where((F.col("x") < F.col("y")) | (F.col("l.id") < F.col("r.id")))
    pairs = met.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()

    # The pairs are the costly step: names and keys are spread by number, not by bytes, which are few.
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k, sizes in places.items():
        # Every k-th character, from each of the first k on: lots of places.
        lot = lambda i: F.array_join(F.filter("c", lambda _, at: F.pmod(at, F.lit(k)) == i), "")  # noqa: B023, E731
        same = held.where(F.col("n").isin(sizes)).repartition(tasks, "p").select("p", F.array_join(F.array_sort("c"), "").alias("all"), *[F.xxhash64(lot(i)).alias(f"h{i}") for i in range(k)])
        same = checkpointed(same)
        duo = [F.struct(F.lit(1 << i | 1 << j).alias("both"), F.lit((2 << j) - 1).alias("upto"), F.xxhash64("all", F.lit(i), f"h{i}", F.lit(j), f"h{j}").alias("key")) for j in range(k) for i in range(j)]
        spread = same.select("p", *[f"h{i}" for i in range(k)], F.inline(F.array(*duo))).repartition(tasks, "key")
        one, other = spread.alias("one"), spread.alias("other")
        agree = sum((F.when(F.col(f"one.h{i}") == F.col(f"other.h{i}"), 1 << i).otherwise(0) for i in range(1, k)), F.when(F.col("one.h0") == F.col("other.h0"), 1).otherwise(0))
        first = agree.bitwiseAND(F.col("one.upto")) == F.col("one.both")
        near = one.join(other, F.col("one.key") == F.col("other.key")).where((F.col("one.p.id") < F.col("other.p.id")) & (F.col("one.both") - F.col("other.both") == 0) & first)
        near = near.select(F.col("one.p").alias("l"), F.col("other.p").alias("r"))
        pairs = pairs.unionByName(near.where(F.levenshtein("l.norm", "r.norm", k - 2) >= 0))
    return pairs


def blocks(names: DataFrame, as_: str) -> DataFrame:
    return names.select(F.col("norm").alias(as_), F.split("norm", " ").alias(f"w{as_}")).select(as_, f"w{as_}", F.explode(F.array_distinct(f"w{as_}")).alias("block"))


def contained(companies: DataFrame, actors: DataFrame, generic: list[str], shortest: int = 8, least: int = 4, gram: int = 4) -> DataFrame:
    """(company_id, actor_id, how): a company's actor of the same normalised name ('exact'), else every actor whose name holds the company's or is held by it ('substring').

    An actor's name has `shortest` characters or more for that, a company's `least`, and what is held isn't made of generic words only. The shorter name's rarest run of
    `gram` characters is joined with all runs of the longer names.
    """
    c = companies.select("company_id", normal_name(F.col("name")).alias("c")).where(F.char_length("c") >= least)
    a = actors.select("actor_id", normal_name(F.col("name")).alias("a")).where("a <> ''")
    exact = c.join(a, c.c == a.a).select("company_id", "actor_id", F.lit("exact").alias("how"))
    open_ = c.join(exact.select("company_id"), "company_id", "left_anti")
    cs, as_ = open_.select(F.col("c").alias("s")).distinct(), a.select(F.col("a").alias("s")).where(F.char_length("s") >= shortest).distinct()

    def runs(names: DataFrame) -> DataFrame:
        at = F.sequence(F.lit(1), F.char_length("s") - gram + 1)
        return names.where(F.char_length("s") >= gram).select("s", F.explode(F.array_distinct(F.transform(at, lambda k: F.substring(F.col("s"), k, F.lit(gram))))).alias("g"))

    def held(short: DataFrame, long: DataFrame) -> DataFrame:
        long_runs = runs(long)
        rare = runs(short).join(long_runs.groupBy("g").count(), "g").groupBy("s").agg(F.count("g").alias("k"), F.min_by("g", F.struct("count", "g")).alias("g"))
        found = rare.select(F.col("s").alias("short"), "g").join(long_runs.select(F.col("s").alias("long"), "g"), "g").where(F.instr("long", F.col("short")) > 0)
        plain = F.size(F.array_except(F.split("short", " "), F.array(*[F.lit(g) for g in generic]).cast("array<string>"))) > 0
        return found.where(plain).select("short", "long")

    pairs = held(cs, as_).toDF("c", "a").unionByName(held(as_, cs).select(F.col("long").alias("c"), F.col("short").alias("a"))).distinct()
    return exact.unionByName(pairs.join(open_, "c").join(a, "a").select("company_id", "actor_id", F.lit("substring").alias("how")))
