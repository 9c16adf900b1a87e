"""Spelling variants: words one edit apart, found through pivotal grams.

Bigrams are ordered from rare to frequent. A word's prefix is its three rarest bigrams (with
every place of the last of them), and its pivots are two of these that do not overlap, chosen
by dynamic programming so that the fewest words have them. One edit destroys at most one of
two disjoint bigrams; so of two words one edit apart, the one whose prefix ends earlier in
the order has a pivot that the other word's prefix holds. The edit also limits where: if it
comes behind the pivot, this stands at the same place, else at the same distance from the
end, and the words agree up to it or from it on. These pairs are verified by edit distance.

Pivots and prefixes are joined on what they agree in, the bigram included, and on the length,
so a frequent bigram is dealt to as many keys as words have beginnings and ends. Bigrams are
broadcast; their number is bounded by the letters of the pattern (90 * 90).

Defined cases: null and empty texts have no words; a null key counts as empty text in the
hash; repeated rows count each; other columns are not read; ties between forms go to the
smaller word in code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, write_stage

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, STRONGER, MISSPELT = 6, 5, 5, 199
#: One edit: at most two bigrams are destroyed, and two disjoint ones are not.
PREFIX = 3


def misspelt(key: Column, word: Column, one_in: int = MISSPELT) -> Column:
    """The word, without one of its letters where the hash of key and word says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % one_in == 0, shorter).otherwise(word)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = MISSPELT) -> DataFrame:
    """(word, n) of all whole texts; counts are added up in tasks before the shuffle. Words
    too short to be compared go before it, as deleting a letter never lengthens them."""
    runs = F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))
    words = docs.select(F.col(key).alias("key"), F.explode(runs).alias("run")).select("key", F.translate("run", UPPER, LOWER).alias("run"))
    words = words.where(F.length("run") >= LEAST_LENGTH).select(misspelt(F.col("key"), F.col("run"), one_in).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def bigrams(words: DataFrame) -> DataFrame:
    """(word, at, gram) for every place."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    return words.select("word", F.explode(places).alias("at")).select("word", "at", F.substring("word", F.col("at"), F.lit(2)).alias("gram"))


def pivots(prefix: Column) -> Column:
    """Two disjoint grams of the prefix that the fewest words have.

    ``prefix`` is an array of (n, at, gram) by place. Going from place to place, the state has
    the best single gram that ends before the last one (``one``), the last gram and the best
    pair so far; a gram is joined with the best one that it does not overlap.
    """
    gram = "struct<n:bigint,at:int,gram:string>"
    nothing = F.struct(F.lit(None).cast(gram).alias("one"), F.lit(None).cast(gram).alias("last"),
                       F.lit(None).cast(f"struct<n:bigint,a:{gram},b:{gram}>").alias("pair"))

    def less(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b < a), b).otherwise(a)

    def step(s: Column, g: Column) -> Column:
        before = less(s["one"], s["last"])
        fits = F.when(s["last"]["at"] <= g["at"] - 2, before).otherwise(s["one"])
        pair = F.when(fits.isNotNull(), F.struct((fits["n"] + g["n"]).alias("n"), fits.alias("a"), g.alias("b")))
        return F.struct(before.alias("one"), g.alias("last"), less(s["pair"], pair).alias("pair"))

    best = F.aggregate(prefix, nothing, step)["pair"]
    return F.array(best["a"], best["b"])


def signatures(words: DataFrame) -> DataFrame:
    """(word, length, last, prefix, pivots): ``last`` is the rank of the prefix's end."""
    grams = bigrams(words)
    ranks = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = grams.join(F.broadcast(ranks), "gram")
    # rare ones first; the gram itself breaks ties, so that the order is the same for all words
    order = F.struct(F.col("n").alias("n"), F.col("gram").alias("gram"), F.col("at").alias("at"))
    held = ranked.groupBy("word").agg(F.array_sort(F.collect_list(order)).alias("grams"))
    last = F.get("grams", F.lit(PREFIX - 1))
    cut = held.withColumn("last", F.struct(last["n"].alias("n"), last["gram"].alias("gram")))
    inside = F.filter("grams", lambda g: F.struct(g["n"].alias("n"), g["gram"].alias("gram")) <= F.col("last"))
    by_place = F.array_sort(F.transform(inside, lambda g: F.struct(g["at"].alias("place"), g["n"].alias("n"), g["at"].alias("at"), g["gram"].alias("gram"))))
    prefix = F.transform(by_place, lambda g: F.struct(g["n"].alias("n"), g["at"].alias("at"), g["gram"].alias("gram")))
    return cut.select("word", F.length("word").alias("length"), "last", prefix.alias("prefix")).withColumn("pivots", pivots(F.col("prefix")))


def near_pairs(signed: DataFrame) -> DataFrame:
    """Distinct (word, near) with edit distance one, in both directions."""
    # behind the edit or before it the words agree: up to the gram, or from it on
    sides = lambda word, at: F.array(
        F.struct(F.lit(0).alias("side"), F.substring(word, F.lit(1), at + 1).alias("same")),
        F.struct(F.lit(1).alias("side"), F.substring(word, at, F.length(word)).alias("same")))
    asked = signed.select(F.col("word").alias("a"), F.col("last").alias("last_a"), "length", F.explode("pivots").alias("g"))
    asked = asked.select("a", "last_a", "length", F.explode(sides(F.col("a"), F.col("g.at"))).alias("s")).select(
        "a", "last_a", "s.side", "s.same", F.explode(F.array(*[F.col("length") + longer for longer in (0, 1, -1)])).alias("length"))
    index = signed.select(F.col("word").alias("b"), F.col("last").alias("last_b"), "length", F.explode("prefix").alias("g"))
    index = index.select("b", "last_b", "length", F.explode(sides(F.col("b"), F.col("g.at"))).alias("s")).select("b", "last_b", "length", "s.side", "s.same")
    found = (asked.join(index, ["side", "same", "length"]).where("a <> b AND last_a <= last_b")
             .where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(found.select(F.col("b").alias("word"), F.col("a").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last form reached. Each round doubles the steps
    taken; forms get ``STRONGER`` times more frequent, so rounds are few."""
    state = write_stage(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = write_stage(state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        drop_stage(state)
        state = after.select("word", "root")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        state.stage_path = after.stage_path


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = MISSPELT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and frequent enough."""
    words = write_stage(word_counts(docs, key, text, one_in), "variant-words")
    signed = write_stage(signatures(words), "variant-signatures")
    pairs = write_stage(near_pairs(signed), "variant-pairs")
    drop_stage(signed)
    with_n = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = with_n.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    strong = -F.col("best.less") >= STRONGER * F.col("n")
    rows = write_stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "variant-forms")
    drop_stage(words, pairs)
    root = roots(rows.where("form IS NOT NULL"))
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), F.col("n_near").cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
