"""SpotSigs document fingerprints: chains of content words that follow common words.

A signature is a common word (an anchor) with the next ``CHAIN`` content words before another anchor, or a content word that
stands in no such chain; a fingerprint is the set of a text's signatures, as sorted 32-bit hashes. Where anchors are rare, as in
other languages, words so take the place of chains one by one: a chain more or less never moves more than its own words. A text
without words stands for itself as a whole, so different texts without words stay apart. ``likeness`` is the Jaccard coefficient of two sets; with a floor it is pruned:
sets whose lengths alone keep them under the floor are never intersected.

``similar`` finds all pairs of different fingerprints at ``threshold`` or more: sets are partitioned by length, so that only
sets in the same or the next partition can be that alike; of each set only its rarest signatures are indexed, as many as a
partner must share one of; pairs met there are compared through the pruned coefficient.

Scale: everything is built-in expressions over one row or equality joins. Equal fingerprints are one class, so copies are
not paired. Signature counts cover the whole corpus and are summed map-side.

Defined cases: null texts are empty texts. Two fingerprints that are both empty cannot occur. Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.shared import materialise

#: Common words that anchor a chain, by language; a caller may pass others.
ANCHORS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "at", "are", "from"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au", "par", "sur", "pas", "avec"),
    "de": ("der", "die", "und", "den", "von", "zu", "sich", "das", "mit", "auf", "für", "dem", "ist", "im", "nicht", "ein", "eine", "als"),
    "es": ("que", "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "para", "su", "al", "lo"),
}
CHAIN = 2


def normalised(text: Column) -> Column:
    """Lower-cased words with one blank around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def signatures(text: Column, anchors: dict[str, tuple[str, ...]] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text, as ``array<int>``."""
    names = sorted({w for words in anchors.values() for w in words})
    any_name = "|".join(names)
    own = F.coalesce(text, F.lit(""))
    follow = rf"(?<= )(?:{any_name})(?: (?!(?:{any_name}) )[^ ]+){{1,{chain}}}(?= )"

    def spotted(words: Column) -> Column:
        """The chains, and the words that a text has besides them."""
        alone = F.array_except(F.split(F.regexp_replace(words, follow, ""), " +"), F.array(F.lit(""), *[F.lit(w) for w in names]))
        return F.concat(F.regexp_extract_all(words, F.lit(follow), F.lit(0)), alone)

    def finish(found: Column) -> Column:
        some = F.when(F.size(found) > 0, found).otherwise(F.array(own))
        return F.array_sort(F.array_distinct(F.transform(some, lambda c: F.shiftright(F.xxhash64(c), 32).cast("int"))))

    # one level of transform a step, so that no step is worked out twice
    return F.transform(F.transform(F.transform(F.array(own), normalised), spotted), finish)[0]


def as_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard of two sets; 0 where it must be under ``floor`` by the lengths alone."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return F.when(F.least(n, m) < F.lit(floor) * F.greatest(n, m), F.lit(0.0)).otherwise(both / (n + m - both))


def similar(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b, likeness)`` for classes of ``prints(sigs)``: pairs of different sets alike enough, named by ``as_text``'s hash."""
    classes = materialise(prints.select("sigs").distinct().select(F.xxhash64("sigs").alias("c"), "sigs", F.size("sigs").alias("n")))
    held = classes.select("c", "n", F.explode("sigs").alias("sig"))
    counts = held.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = held.join(counts, "sig").groupBy("c").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(1 / threshold))).cast("int")
    index = ranked.select("c", "n", part.alias("part"), F.explode(F.slice("by_df", F.lit(1), keep.cast("int"))).alias("p")).select("c", "n", "part", F.col("p.sig").alias("sig"))
    left = index.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("part_a"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = index.select(F.col("c").alias("b"), F.col("n").alias("n_b"), "part", "sig")
    lengths = (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
    met = left.join(right, ["sig", "part"]).where(lengths & ((F.col("part") > F.col("part_a")) | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    sets = classes.select("c", "sigs")
    pairs = met.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("x"), F.col("y"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)


def partners(threshold: float, n: int) -> int:
    """How many of its rarest signatures a set of ``n`` must index."""
    return n - ceil(threshold * n) + 1
