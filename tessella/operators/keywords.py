"""Keyword lists from text: document frequency, enrichment, headers, selection and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEADER_STEMS, STOP_WORDS, any_term, extract, headers, letter_runs, sentences
from .term_automaton import term_frequency

#: Words that are enriched beside clinical content but say nothing about it, by kind; fixed values.
NOISE = {
    "dosing": "qhs qam qday qpm qid bid tid prn bedtime nightly noon daily once three wake",
    "salt": "oxalate mesylate fumarate tartrate hcl carbonate polacrilex succinate maleate citrate sulfate",
    "route": "solution spray release sustained disintegrating delayed extended transdermal film tablets tabs oral sublingual acting half",
    "chart": "pmhx pmh cont prescribing trials use continued pfo hld niddm ibs presents held takes remote adding precautions intentional",
    "unrelated": "fibromyalgia migraines toxicity pack mouth",
    "vague": "features waning waxing untreated suffering fear",
    "process": "restart titrated tapering weaning uptitrate uptitrated uptitration discontinuing trialed",
    "nondiagnostic": "disability deficit diagnoses longstanding",
    "side effect": "itch itching pruritis pruritus",
    "artifact": "melatin maalox fioricet precedex",
}
#: Brand names among additional terms; fixed values.
BRANDS = (
    "prozac klonopin neurontin depakote ativan haldol zyprexa keppra valium dilantin suboxone topamax ritalin latuda buproprion "
    "narcan lyrica celexa wellbutrin effexor ambien cymbalta abilify adderall lamictal lexapro risperdal xanax seroquel zoloft benadryl"
).split()
#: Abbreviations and general indicators that are always part of the list; fixed values.
ABBREVIATIONS = ["ADHD", "GAD", "MDD", "OCD", "PTSD"]
INDICATORS = "psychiatric mental substance trauma confusion confused cognitive panic disorder abuse alcohol tobacco seizure".split()


def noise_words() -> set[str]:
    return {w for words in NOISE.values() for w in words.split()}


def term_document_frequency(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """For each term the documents that have it between word boundaries; terms without documents count 0."""
    return term_frequency(docs, text, terms).select("term", "n_docs")


def top_terms(freq: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms (then by name)."""
    return freq.orderBy(F.desc("n_docs"), "term").limit(n)


def top_share(freq: DataFrame, share: float = 0.4) -> DataFrame:
    """The most frequent ``share`` of the terms, their number rounded half to even."""
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.desc("n_docs"), "term"))
    keep = F.bround(F.count(F.lit(1)).over(one) * F.lit(share), 0)
    return freq.withColumn("rn", rank.cast("long")).withColumn("keep", keep.cast("long")).where("rn <= keep").drop("keep")


def sentence_words(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(word, in_diagnostic) for each indicator word of each sentence; a sentence with any term is diagnostic."""
    sentence = docs.select(F.explode(sentences(F.lower(text), lines=True)).alias("s"))
    marked = sentence.select(letter_runs(F.col("s")).alias("w"), F.col("s").rlike(any_term(terms)).alias("is_diag"))
    # a set of stop words beside the rows is faster than a search of an array within them
    return marked.select(F.explode("w").alias("word"), "is_diag").where((F.length("word") >= 3) & ~F.col("word").isin(*STOP_WORDS))


def enrichment(docs: DataFrame, text: str, terms: list[str], least: int = 500, floor_one: bool = False, exclude: list[str] = ()) -> DataFrame:
    """How much more often a word occurs in diagnostic sentences than in others, each by all words of its side.

    ``floor_one``: a word that never occurs elsewhere counts as once there; else its ratio is infinite.
    """
    words = sentence_words(docs, text, terms)
    counts = words.groupBy("word").agg(F.count_if("is_diag").alias("diag"), F.count_if(~F.col("is_diag")).alias("other"))
    totals = counts.agg(F.sum("diag").alias("all_diag"), F.sum("other").alias("all_other"))
    own = counts.where((F.col("diag") > 0) & (F.col("diag") + F.col("other") >= least))
    if exclude:
        own = own.where(~F.col("word").isin(*exclude))
    own = own.join(F.broadcast(totals), F.lit(True))
    other = F.greatest("other", F.lit(1)) if floor_one else F.col("other")
    ratio = (F.col("diag") / F.col("all_diag")) / (F.nullif(other, F.lit(0)) / F.col("all_other"))
    return own.select(
        "word", F.col("diag").alias("count_in_diagnostic"), F.col("other").alias("count_in_other"), (F.col("diag") + F.col("other")).alias("total_count"),
        F.coalesce(ratio, F.lit(float("inf"))).alias("enrichment_ratio"),
    )


def additional_terms(scores: DataFrame, exclude: list[str], ratio: float = 3.5) -> DataFrame:
    """Enriched words that are neither known terms nor noise, with is_brand."""
    known = sorted(set(exclude) | noise_words())
    return scores.where((F.col("enrichment_ratio") >= ratio) & ~F.col("word").isin(*known)).select("word", F.col("word").isin(*BRANDS).alias("is_brand"))


def header_frequency(docs: DataFrame, text: str) -> DataFrame:
    """Occurrences of each header line and whether it is relevant."""
    counts = docs.select(F.explode(headers(F.col(text))).alias("header")).groupBy("header").agg(F.count(F.lit(1)).alias("n"))
    stems = F.array(*[F.lit(s) for s in HEADER_STEMS])
    return counts.withColumn("relevant", F.exists(stems, lambda s: F.contains("header", s)))


def top_headers(freq: DataFrame, n: int = 16) -> DataFrame:
    return freq.where("relevant").orderBy(F.desc("n"), "header").limit(n)


def assemble(sections: dict[str, DataFrame]) -> DataFrame:
    """Terms of all sections, each named once: (section, term), a term's first section in order of the sections."""
    out = None
    for i, (name, df) in enumerate(sections.items()):
        one = df.select(F.lit(i).alias("o"), F.lit(name).alias("section"), df[df.columns[0]].cast("string").alias("term"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(F.lower("term").alias("k")).agg(F.min(F.struct("o", "section", "term")).alias("x")).select("x.section", "x.term")


def extracted(docs: DataFrame, text: str, terms: list[str], least: int = 100) -> DataFrame:
    """``docs`` with the sentences that have keywords, or the full text, and how they were found."""
    return docs.withColumns(extract(F.col(text), terms, least))


def section_positions(docs: DataFrame, text: str, sections: dict[str, tuple[str, str]], chunk_size: int, tokens_before=None) -> DataFrame:
    """For each section: documents, found, mean and median token position, and shares within and beyond the first chunk.

    ``tokens_before`` (Column -> Column) counts the tokens of the text before the match; blanks part tokens by default.
    """
    tokens_before = tokens_before or (lambda c: F.regexp_count(c, F.lit("\\S+")))
    low = docs.where(F.length(text) > 0).select(F.col(text).alias("raw"), F.lower(text).alias("low"))
    parts = F.array(*[F.struct(F.lit(n).alias("section"), F.regexp_instr("low", F.lit(p)).alias("at")) for n, (p, _) in sections.items()])
    found = low.select("raw", F.explode(parts).alias("s")).select("s.section", F.when(F.col("s.at") > 0, tokens_before(F.substr("raw", F.lit(1), F.col("s.at") - 1))).alias("pos"))
    return found.groupBy("section").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("pos").alias("n_found"), (F.count("pos") * 100.0 / F.count(F.lit(1))).alias("found_pct"),
        F.avg("pos").alias("mean_position"), F.percentile("pos", F.lit(0.5)).alias("median_position"),
        F.coalesce(F.count_if(F.col("pos") <= chunk_size) * 100.0 / F.nullif(F.count("pos"), F.lit(0)), F.lit(0.0)).alias("within_pct"),
        F.count_if(F.col("pos") > chunk_size).alias("n_beyond"),
    )


def stop_words() -> list[str]:
    return list(STOP_WORDS)


def contains_any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
