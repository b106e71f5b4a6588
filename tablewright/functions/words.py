"""Text expressions: words, tokens, n-grams, stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word for the text roles and for term weights, and the
# English stop words of Spark's StopWordsRemover.
NON_SPACE = r"(?U)\S+"
TERM = r"[\p{L}\p{N}_]{2,}"
NON_WORD = r"\W+"
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now i'll you'll
he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split()


def word_count(col: Column) -> Column:
    """Number of runs of non-space characters; null text counts none."""
    return F.coalesce(F.size(F.regexp_extract_all(col, F.lit(NON_SPACE), F.lit(0))), F.lit(0))


def more_words_than(col: Column, n: int) -> Column:
    """Whether a text has more than ``n`` words; reading stops at the first one too many."""
    # n + 1 words and n spaces take at least that many bytes, a length stored with the text.
    return (F.octet_length(col) > 2 * n) & col.rlike(rf"(?U)^\s*(?:\S+\s+){{{n}}}\S")


def terms(col: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(TERM), F.lit(0))


def tokenize(col: Column) -> Column:
    """Lower-cased pieces between non-word characters, empty pieces dropped."""
    return F.filter(F.split(F.lower(col), NON_WORD), lambda w: F.length(w) > 0)


def remove_stopwords(tokens: Column, stopwords: list[str] | None = None) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(stopwords or STOPWORDS))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Runs of ``n`` neighbouring tokens joined by a space."""
    runs = tokens
    for shift in range(1, n):
        # The longer side ends in nulls, which concat turns into a null run.
        later = F.slice(tokens, F.lit(shift + 1), F.greatest(F.size(tokens) - F.lit(shift), F.lit(0)))
        runs = F.zip_with(runs, later, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(runs, lambda r: r.isNotNull())
