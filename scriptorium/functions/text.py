"""Text to terms, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that end a run of content words.
STOP_WORDS = """
a about above after again against all also am an and any are aren as at
be because been before being below between both but by
can cannot could couldn
did didn do does doesn doing don down during
each either else
few for from further
had hadn has hasn have haven having he her here hers herself him himself his how however
i if in into is isn it its itself
just
me more most much must my myself
no nor not now
of off on once only or other others ought our ours ourselves out over own
same shan she should shouldn so some such
than that the their theirs them themselves then there therefore these they this those through thus to too
under until up upon us
very
was wasn we were weren what when where whether which while who whom why will with within without won would wouldn
you your yours yourself yourselves
one two three
across along among around behind beside besides beyond
however moreover furthermore additionally notably particularly respectively
whereas thereby hence accordingly consequently nevertheless nonetheless
towards toward per eg ie etc et al
via using use used uses useful
show shows shown showing
present presents presented presenting
propose proposes proposed proposing
paper papers work works
result results
approach approaches
method methods
based
we
""".split()
# Markup words whose backslash was lost.
MARKUP_WORDS = """
textbf textit texttt emph textrm textsf mathbb mathcal mathbf mathrm mathit
begin end item label ref cite citep citet eqref
frac sqrt sum prod int lim log exp min max argmin argmax
alpha beta gamma delta epsilon theta lambda mu sigma tau phi psi omega
cdot times leq geq neq approx sim infty
left right quad qquad hspace vspace newline linebreak
section subsection subsubsection paragraph footnote
""".split()
DROPPED = sorted({*STOP_WORDS, *MARKUP_WORDS})
#: White space as Unicode has it, written so that both Java and RE2 read it.
BLANKS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The beginning of a text up to its n-th word, as a format of n.
FIRST_WORDS = "^(?:" + f"{BLANKS}*+[^{BLANKS[1:-1]}]++".replace("{", "{{").replace("}", "}}") + "){{0,{}}}"
MARKUP = r"\\[A-Za-z]*|\$"
APOSTROPHES = "['’]"
BREAKS = r'[.!?;:,()\[\]{}"“”—–/\\|\n\r]'
SEPARATORS = r"[^\p{L}\p{Nd}\-]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def without_markup(text: Column | str) -> Column:
    """Control words and dollar signs become spaces."""
    return F.regexp_replace(_col(text), MARKUP, " ")


def _marked(text: Column | str) -> Column:
    """For each clause its tokens in order, null where a token is dropped and breaks the run."""
    plain = F.regexp_replace(without_markup(F.coalesce(_col(text), F.lit(""))), APOSTROPHES, "")
    split = lambda c: F.split(F.translate(c, "_", "-"), SEPARATORS, -1)
    bare = lambda c: F.filter(F.transform(split(c), lambda x: F.regexp_replace(F.lower(x), "^-+|-+$", "")), lambda x: x != "")
    kept = lambda x: F.when((F.octet_length(x) >= 2) & ~x.isin(DROPPED) & ~x.rlike("^[0-9]+$"), x)
    return F.transform(F.split(plain, BREAKS, -1), lambda c: F.transform(bare(c), kept))


#: A token, hyphens within it included, or a character that ends a clause.
TOKEN = r"[\p{L}\p{Nd}]++(?:-++[\p{L}\p{Nd}]++)*+"


def tokens(text: Column | str) -> Column:
    """The tokens of a text in order, in their own case, with a sign of one byte where a clause ends.

    One pass of a regular expression; counts() then tells for each whether it does.
    """
    plain = F.translate(without_markup(F.coalesce(_col(text), F.lit(""))), "_“”—–'’", "-....")
    return F.regexp_extract_all(plain, F.lit(f"{TOKEN}|{BREAKS}"), F.lit(0))


def counts(low: Column) -> Column:
    """Whether a lower-cased token counts; those that don't, and ends of clauses, break a run."""
    return (F.octet_length(low) >= 2) & ~low.isin(DROPPED) & ((F.substring(low, 1, 1) > "9") | ~low.rlike("^[0-9]+$"))


def kept(token: Column) -> Column:
    """The lower-cased token, null if it doesn't count."""
    return F.when(counts(F.lower(token)), F.lower(token))


def terms(text: Column | str, n: int = 2) -> Column:
    """All n-grams of up to n tokens within runs, with repeats."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def grams(tokens: Column) -> Column:
        out = [F.filter(tokens, lambda x: x.isNotNull())]
        joined = tokens
        for i in range(2, n + 1):
            joined = F.zip_with(joined, F.slice(tokens, i, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
            out.append(F.filter(joined, lambda x: x.isNotNull()))
        return F.concat(*out)

    return F.flatten(F.transform(_marked(text), grams))


def unigrams(text: Column | str) -> Column:
    return terms(text, 1)


def char_grams(text: Column | str, n: int) -> Column:
    """All windows of n characters of the lower-cased text with single spaces; none if it is shorter."""
    plain = squash(F.lower(F.coalesce(_col(text), F.lit(""))))
    chars = F.regexp_extract_all(plain, F.lit("(?s)."), 0)

    def windows(c: Column) -> Column:  # c is bound once; each gram joins n neighbours
        joined = c
        for i in range(2, n + 1):
            joined = F.zip_with(joined, F.slice(c, i, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, b))
        return F.filter(joined, lambda x: x.isNotNull())

    return F.flatten(F.transform(F.array(chars), windows))


def squash(text: Column | str) -> Column:
    """Runs of white space become one space, none at either end."""
    return F.trim(F.regexp_replace(_col(text), BLANKS + "+", " "))


def words(text: Column | str) -> Column:
    """The words between white space."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), BLANKS + "+", -1), lambda x: x != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def first_words(text: Column | str, n: int) -> Column:
    """The first n words, with an ellipsis if there are more."""
    all_words = words(text)
    head = F.array_join(F.slice(all_words, 1, n), " ")
    return F.when(F.size(all_words) > n, F.concat(head, F.lit("…"))).otherwise(head)
