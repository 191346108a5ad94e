"""Names in running text and in questions, by capital letters; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorequarry.functions.text import SPACE, strip_space

#: Words that are no names in passages, in questions, and in the search for a seed (fixed values).
PASSAGE_STOPWORDS = "The A An According Volume Chapter Figure Plate Official Age What Which Whose In On To From Its".split()
QUESTION_STOPWORDS = "Which What Who Whose Where When Why How According The A An In On To From".split()
SEED_STOPWORDS = "Which What Who Whose Where When According In On To The A An".split()
NOISE_NAMES = "This Instead The A An Which What Who Whose Any Likewise Descriptions Registry".split()


def _capital_runs(c: Column, connectors: str, most: int) -> Column:
    run = rf"(?<!{'[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]'})((?:[A-Z][A-Za-z'-]+(?:{SPACE}+(?:{connectors}))?{SPACE}*){{1,{most}}})"
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(run), 1), lambda x: strip_space(F.regexp_replace(x, rf"{SPACE}+", " ")))


def passage_entities(c: Column) -> Column:
    """Sorted distinct runs of up to six capitalised words, each with an optional connector; stopwords go before a last connector does."""
    kept = F.filter(_capital_runs(c, "of|the|and|de|von|van", 6), lambda x: (F.length(x) >= 3) & ~x.isin(*PASSAGE_STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.regexp_replace(x, r" (?:of|the|and)$", ""))))


def question_entities(c: Column) -> Column:
    """Runs of up to five capitalised words in order, repeats and last connectors kept."""
    return F.filter(_capital_runs(c, "of|the|and", 5), lambda x: ~x.isin(*QUESTION_STOPWORDS))


def analysed_entities(c: Column) -> Column:
    """Longest runs of capitalised words in order of first sight; single letters count, stopwords too."""
    word = r"[A-Z][\p{L}\p{N}_'-]*"
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({word}(?:{SPACE}+{word})*)(?![\p{{L}}\p{{N}}_])"), 1)
    return F.array_distinct(runs)


def seed_entity(question: Column) -> Column:
    """The last run of two or more capitalised words that are no stopwords; the whole question if there is none."""
    tokens = F.filter(F.split(F.replace(F.coalesce(question, F.lit("")), F.lit("?"), F.lit("")), rf"{SPACE}+"), lambda w: w != "")
    tokens = F.transform(tokens, lambda w: F.regexp_replace(w, r"""^[,.:;()\[\]{}"']+|[,.:;()\[\]{}"']+$""", ""))
    # Words that end a run become a mark; what is left between marks are the runs.
    marked = F.transform(tokens, lambda w: F.when(w.rlike(r"^\p{Lu}") & ~w.isin(*SEED_STOPWORDS), w).otherwise(F.lit("\u0001")))
    runs = F.transform(F.split(F.array_join(marked, " "), " ?\u0001 ?"), strip_space)
    return F.coalesce(F.try_element_at(F.filter(runs, lambda r: r.contains(" ")), F.lit(-1)), question)
