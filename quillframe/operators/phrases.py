"""Phrases and rewriting of texts (STR-5, PIP-13, STR-29, STR-21): every change of a text is found by join and made in one expression.

A text is cut at the matches of a pattern; the pieces between them stay as they are and the matches are looked up, so positions
never shift, and repeated matches cost nothing more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that anchor a method's name, words that never begin one, phrases that name nothing, and the ligatures that extraction loses.
HEAD_NOUNS = (
    "editing", "repair", "recombination", "mutagenesis", "mechanism", "pathway", "screen", "screening", "assay", "profiling",
    "effect", "effects", "outcome", "outcomes", "response", "activity", "vector", "vectors", "nanoparticle", "nanoparticles", "atlas",
    "contact", "contacts", "variant", "variants", "design", "prediction", "alignment", "architecture", "structure",
    "model", "models", "embedding", "embeddings", "tokenization", "pretraining", "fine-tuning", "objective", "benchmark", "benchmarks",
    "dataset", "datasets", "delivery", "system", "systems",
)
LEADING_STOPWORDS = (
    "the", "a", "an", "our", "their", "its", "this", "that", "these", "those", "any", "each", "every", "both", "no", "some",
    "of", "for", "and", "or", "but", "with", "to", "on", "in", "at", "by", "as", "than", "into", "onto", "from", "over", "under",
    "across", "beyond", "when", "where", "while", "using", "based", "given", "showing", "including", "excluding", "restricted", "limited",
    "outperforms", "outperforming", "improves", "improving", "exceeds", "exceeding", "requires", "requiring", "yields", "yielding",
    "most", "same", "only", "also", "here", "now", "still", "already", "s",
)
STOP_PHRASES = (
    "this work", "these results", "method", "approach", "results", "model", "models", "authors", "paper", "study", "framework", "algorithm", "pipeline", "system",
    "analysis", "experiment", "experiments", "dataset", "datasets", "benchmark", "design", "effect", "effects", "outcome", "pathway", "mechanism", "response", "activity",
    "full model", "single model", "based model", "based models", "such model", "such models", "based effect", "based effects", "rare variants", "common variants", "seq dataset", "seq datasets",
)
LIGATURES = ("ffi", "ffl", "fi", "fl", "ff")
SPOKE_SECTION = r"(?s)\A(.*?## How it appears across the corpus\n)(.*?)((?:\n## .*)?)\z"
SPOKE = r"-\s*\[\[[^\]\|#]+\]\]"


def replaced(text: Column, pattern: str, new: Column, group: int = 0) -> Column:
    """The text with each match of the pattern as the map ``new`` has it, or as it is.

    Java's split and find agree on where matches are, so pieces and matches interleave."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    told = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.when(i < F.size(found), F.coalesce(F.try_element_at(new, found[i]), found[i])), F.lit(""))))
    return F.array_join(told, "")


def lower_phrases(text: Column, heads: tuple[str, ...] = HEAD_NOUNS, stop: tuple[str, ...] = LEADING_STOPWORDS, drop: tuple[str, ...] = STOP_PHRASES) -> Column:
    """Lower-case phrases of two or three words that end in a head noun, in order, without words that never begin one."""
    nouns = "|".join(sorted(heads, key=lambda h: (-len(h), h)))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\b(?:[a-z][a-z\-]*(?:\s+|-)){{1,2}}(?:{nouns})\b"), F.lit(0))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", " "), r"'s\b", ""))
    cut = F.transform(plain, lambda x: F.regexp_replace(x, rf"^(?:(?:{'|'.join(stop)}) )+", ""))
    return F.filter(cut, lambda x: F.contains(x, F.lit(" ")) & ~x.isin(*drop) & ~x.isin(*stop))


def phrase_counts(texts: DataFrame, key: str, phrases: Column) -> DataFrame:
    """(phrase, n, alone, texts): how often each phrase occurs, how often outside any longer phrase of its text, and in how many texts.

    A phrase is inside a longer one if its words end it; a three-word phrase has one such, so that is one equi-join."""
    every = texts.select(key, F.explode(phrases).alias("phrase")).groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("n"))
    inside = every.select(key, F.regexp_replace("phrase", "^[^ ]+ ", "").alias("phrase"), "n").where(F.contains(F.col("phrase"), F.lit(" ")))
    inside = inside.groupBy(key, "phrase").agg(F.sum("n").alias("within"))
    told = every.join(inside, [key, "phrase"], "left").select(key, "phrase", "n", F.greatest(F.col("n") - F.coalesce("within", F.lit(0)), F.lit(0)).alias("alone"))
    return told.groupBy("phrase").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"), F.count(F.lit(1)).alias("texts"))


def upgraded_spokes(hubs: DataFrame, claims: DataFrame) -> DataFrame:
    """(hub, body, upgraded, skipped) of hubs (hub, term, body): bare ``- [[stem]]`` bullets of their section on the corpus lead to the
    stem's first claim (stem, slug, section_rank, position, text) that has the term as words of its own.

    Bullets with a fragment or alias stay, and so does everything outside that section; a second run changes nothing."""
    part = lambda n: F.regexp_extract("body", SPOKE_SECTION, n)
    spokes = F.regexp_extract_all(part(2), F.lit(SPOKE), F.lit(0))
    asked = hubs.where(F.trim("term") != "").select("hub", F.lower(F.trim("term")).alias("term"), F.explode(F.array_distinct(spokes)).alias("spoke"))
    asked = asked.withColumn("stem", F.element_at(F.split(F.regexp_extract("spoke", r"\[\[([^\]]+)\]\]", 1), "/"), -1))
    escaped = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), F.col("term"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    held = asked.join(claims, "stem").where(F.contains(F.lower("text"), F.col("term"))).where(F.regexp_like("text", escaped))
    best = held.groupBy("hub", "spoke").agg(F.min(F.struct("section_rank", "position", "slug")).alias("b"))
    new = best.select("hub", "spoke", F.regexp_replace("spoke", r"\]\]$", "").alias("lead"), F.col("b.slug").alias("slug"))
    per = new.groupBy("hub").agg(F.map_from_entries(F.collect_list(F.struct("spoke", F.concat("lead", F.lit("#"), "slug", F.lit("]]"))))).alias("_new"))
    told = hubs.join(per, "hub", "left").withColumn("_new", F.coalesce("_new", F.create_map().cast("map<string,string>")))
    n = F.size(F.filter(spokes, lambda x: F.map_contains_key("_new", x)))
    body = F.when(n > 0, F.concat(part(1), replaced(part(2), SPOKE, F.col("_new")), part(3))).otherwise(F.col("body"))
    asks = F.when(F.trim("term") != "", F.size(spokes)).otherwise(0)
    return told.select("hub", body.alias("body"), n.cast("long").alias("upgraded"), (asks - n).cast("long").alias("skipped"))


#: A damaged word has control characters of the C1 block inside or at its ends; a bare one lost its ligature without a trace.
_C1 = "\u0080-\u009f"
DAMAGED, BARE = rf"[A-Za-z-]*[{_C1}]+[A-Za-z{_C1}-]*", rf"(?<![\p{{L}}\p{{N}}{_C1}-])[a-z]{{3,11}}(?![\p{{L}}\p{{N}}{_C1}-])"


def known_words(texts: DataFrame, text: str, least: int = 5) -> DataFrame:
    """(word): lower-case words of letters that the texts themselves have ``least`` times or more: the dictionary."""
    words = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.lower(text), F.lit("")), F.lit(rf"(?<![\p{{L}}\p{{N}}{_C1}])[a-z]{{2,}}(?![\p{{L}}\p{{N}}{_C1}])"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


def repairs(texts: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """(damaged, repaired) for each different word of the texts that has a repair among the known ``words``.

    A damaged word takes the first ligature, in their order, that gives a known word (two gaps at most, each run of control characters a gap; parts of a hyphenated
    word are looked up one by one); a bare word that isn't known takes an insertion only if exactly one gives a known word."""
    every = lambda p: texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(0)))).alias("damaged")).distinct()
    ligatures = F.array(*map(F.lit, LIGATURES))
    one_gap = F.transform(ligatures, lambda x: F.regexp_replace("damaged", f"[{_C1}]+", x))
    # Two gaps: each ligature in the first, then each in the second.
    two_gaps = F.flatten(F.transform(ligatures, lambda x: F.transform(ligatures, lambda y: F.regexp_replace(F.regexp_replace("damaged", rf"\A([^{_C1}]*)[{_C1}]+", F.concat(F.lit("$1"), x)), f"[{_C1}]+", y))))
    gaps = F.regexp_count("damaged", F.lit(f"[{_C1}]+"))
    tried = every(DAMAGED).where(gaps <= 2).select("damaged", F.posexplode(F.when(gaps == 1, one_gap).otherwise(two_gaps)).alias("place", "candidate"))
    parts = tried.select("damaged", "place", "candidate", F.explode(F.array_distinct(F.filter(F.split(F.lower("candidate"), "-"), lambda x: x != ""))).alias("word"))
    met = parts.join(words.withColumn("_k", F.lit(1)), "word", "left").groupBy("damaged", "place", "candidate").agg(F.count(F.lit(1)).alias("of"), F.count("_k").alias("known")).where("of = known")
    first = met.groupBy("damaged").agg(F.min(F.struct("place", "candidate")).alias("b")).select("damaged", F.col("b.candidate").alias("repaired"))
    bare = every(BARE).join(words, F.col("damaged") == F.col("word"), "left_anti")
    places = F.sequence(F.lit(0), F.length("damaged"))
    inserted = F.flatten(F.transform(places, lambda i: F.transform(ligatures, lambda x: F.concat(F.substring("damaged", F.lit(1), i), x, F.substring("damaged", i + 1, F.length("damaged"))))))
    hit = bare.select("damaged", F.explode(inserted).alias("word")).join(words, "word")
    # The same word by two insertions is two matches, so it stays.
    only = hit.groupBy("damaged").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("repaired")).where("n = 1").select("damaged", "repaired")
    return first.unionByName(only)


def repaired(texts: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``texts`` with its words repaired; the repairs a text needs are met by join, none is broadcast."""
    pattern = f"{DAMAGED}|{BARE}"
    asked = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)))).alias("damaged")).join(found, "damaged")
    per = asked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("damaged", "repaired"))).alias("_new"))
    told = texts.join(per, key, "left")
    return told.withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(replaced(F.col(text), pattern, F.col("_new")))).drop("_new")
