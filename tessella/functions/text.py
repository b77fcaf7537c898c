"""Sentences, words, terms, headers, and overlapping token windows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never count as indicators; fixed values.
STOP_WORDS = (
    "a an the and or but if is was were be been being to of in on at for with "
    "without by from as it its this that these those he she they we you i his her their our your "
    "not no yes do does did have has had will would can could should may might shall must "
    "mg po qd bid tid qid prn year old male female patient pt s p also noted well into than"
).split()

#: Section patterns and how much they matter; fixed values.
SECTIONS = {
    "Chief Complaint": ("chief complaint[s]?:?", "High"),
    "History of Present Illness": ("history of present illness:?", "High"),
    "Past Medical History": ("past medical history:?", "High"),
    "Social History": ("social history:?", "High"),
    "Family History": ("family history:?", "Medium"),
    "Physical Exam": ("physical exam[ination]?:?", "Low"),
    "Pertinent Results": ("pertinent results:?", "Low"),
    "Brief Hospital Course": ("brief hospital course:?", "Medium"),
    "Discharge Diagnosis": ("discharge diagnosis:?|discharge diagnos[ie]s:?", "High"),
}

#: Stems of relevant section headers; fixed values.
HEADER_STEMS = ["diagnos", "medication", "mental status", "psychiatric", "social history", "substance"]


def whitespace_tokens(c: Column) -> Column:
    """Parts between blanks; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\\s+", -1), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit("\\S+")), F.lit(0)).cast("long")


def sentences(c: Column, lines: bool = False) -> Column:
    """Parts after . ! ? and blanks; with ``lines`` also between line feeds."""
    return F.split(c, "(?<=[.!?])\\s+|\\n+" if lines else "(?<=[.!?])\\s+", -1)


def letter_runs(c: Column) -> Column:
    """Runs of a-z and '."""
    return F.regexp_extract_all(c, F.lit("([a-z']+)"), F.lit(1))


def indicator_words(sentence: Column, least: int = 3) -> Column:
    """Runs of a-z and ', of at least ``least`` characters, without stop words."""
    words = letter_runs(sentence)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def quoted(term: str) -> str:
    """A pattern that matches the term literally, in Java's and other engines' syntax."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def any_term(terms: list[str]) -> str:
    """A pattern for any of the terms between word boundaries, longest first."""
    return "\\b(" + "|".join(quoted(t) for t in sorted(set(terms), key=lambda t: (-len(t), t))) + ")\\b"


def mentions(c: Column, terms: list[str]) -> Column:
    """True where any term occurs as a substring, case folded."""
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)) if terms else F.lit(False)


def keyword_sentences(c: Column, terms: list[str]) -> Column:
    low_terms = F.array(*[F.lit(t.lower()) for t in terms]).cast("array<string>")
    return F.filter(sentences(c), lambda s: F.exists(low_terms, lambda t: F.contains(F.lower(s), t)))


def extract(c: Column, terms: list[str], least: int = 100) -> dict[str, Column]:
    """Sentences with keywords; the full text if there are none, or less than ``least`` characters of them."""
    kept = keyword_sentences(c, terms)
    joined = F.array_join(kept, " ")
    fallback = F.length(F.btrim(joined)) < least
    return {
        "extraction_method": F.when(fallback, "full_text_fallback").otherwise("psychiatric_extraction"),
        "n_sentences": F.size(sentences(c)).cast("long"),
        "n_kept": F.size(kept).cast("long"),
        "extracted": F.when(fallback, c).otherwise(joined),
    }


def headers(c: Column) -> Column:
    """Lines that are a header: letters, blanks, slashes and hyphens, a colon, and nothing else."""
    found = F.regexp_extract_all(c, F.lit("(?m)^([A-Za-z][A-Za-z /\\-]{2,40}):\\s*$"), F.lit(1))
    return F.transform(found, lambda h: F.lower(F.btrim(h)))


def window_spans(n: Column, size: int, overlap: int) -> Column:
    """(chunk_idx, total_chunks, start_token, end_token) of the windows of ``n`` tokens, in closed form."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be under size")
    stride = size - overlap
    total = F.greatest(F.ceil((n - overlap) / F.lit(float(stride))), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), total - 1),
        lambda i: F.struct(
            i.cast("long").alias("chunk_idx"), total.cast("long").alias("total_chunks"), (i * stride).cast("long").alias("start_token"),
            F.least(i * stride + size, n).cast("long").alias("end_token"),
        ),
    )


def chat(system: str, text: Column, answer: Column) -> Column:
    """System, user and assistant turns of a training example."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", F.concat(F.lit("Discharge Summary:\n"), text)), turn("assistant", answer))
