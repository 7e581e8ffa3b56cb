"""Text operators: overlap of words, kinds of constants, triggers, times, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count as overlap.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
# Phrases that call for counting, comparing and superlatives.
COUNT_PHRASES = ("the count of", "how many", "how much", "amount of", "what number of", "total number of", "the number of", "quantity of")
SUPERLATIVE_PHRASES = (" most ", " first ", " maximum ", " minimum ", " max ", " min ")
COMPARE_PHRASES = (" at most ", " equal ", " after ", " under ", " below ", " within ", " over ", " at least ", " exceeds ", " more ", " before ", " prior ")

MOST_PHRASES = (" last ", "biggest", "tallest", "latest", "maximum", " most", "heaviest", "highest", "max", "largest", "greatest", "newest", "fastest", "longest", "ultimate", "brightest")
LEAST_PHRASES = (
    "lowest", "least", "first", "smallest", "shortest", "minimum", "earliest", "nearest", "skinniest", "skinnest", "closest", "fewest", "oldest", "tiniest", "lightest", "newest", "weakest", "darkest",
)
BELOW_PHRASES = (
    "at most", "less than", "equal to or smaller", "less than or equal to", "less or equal to", "smaller than", "lower than", "same as or less than", "after", " under ", "below", "fewer than", "or less", "lesser value than",
    "shorter than", "less that", "within",
)
ABOVE_PHRASES = (
    "greater or equal to", " over ", "or greater", "at least", "larger than", "not sooner than", "more than", "more then", "no less than", "not less than", "greater than", "exceeds", "more that", "or more", "fatter than",
    "longer than", "bigger than", "no less", "heavier than", "no earlier than", "larger amount than",
)


def tokens(c: Column) -> Column:
    """Lower-case tokens; the marks , . ; : # _ - ? part them as white space does."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[,.;:#_?-]", " "), r"\s+"), lambda t: t != "")


def has_token_overlap(a: Column, b: Column) -> Column:
    """Whether a token of ``a`` that is no stop word is a token of ``b``."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.arrays_overlap(F.array_except(tokens(a), stop), tokens(b))


def argsort_similar(scores: Column) -> Column:
    """The places (from 0) of an array of similarities, the highest first, equal ones in their order; null counts as lowest."""
    pairs = F.transform(scores, lambda s, i: F.struct((-F.coalesce(s.cast("double"), F.lit(float("-inf")))).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def operator_triggers(question: Column) -> Column:
    """Array of COUNT, ARGMAX, ARGMIN, <=, <, >= and > that phrases of a question call for."""
    q = F.lower(question)
    some = lambda phrases, *names: [F.when(_any(q, phrases), n) for n in names]
    return F.array_compact(F.array(*some(COUNT_PHRASES, "COUNT"), *some(MOST_PHRASES, "ARGMAX"), *some(LEAST_PHRASES, "ARGMIN"), *some(BELOW_PHRASES, "<=", "<"), *some(ABOVE_PHRASES, ">=", ">")))


def from_global_id(value: Column) -> Column:
    """A knowledge-graph id /m/06w as m.06w."""
    return F.when(value.rlike(r"^/[a-z]/.+$"), F.regexp_replace(value, r"^/([a-z])/", "$1."))


def to_global_id(mid: Column) -> Column:
    """An id m.06w as /m/06w."""
    return F.when(mid.rlike(r"^[a-z]\.[^.]+$"), F.regexp_replace(mid, r"^([a-z])\.", "/$1/"))


def bare_literal(literal: Column) -> Column:
    """A literal without quotes, angle brackets and the offset -08:00: value, or value^^datatype."""
    value, kind = _literal_parts(literal)
    return F.when(kind != "", F.concat(value, F.lit("^^"), kind)).otherwise(value)


def literal_value(literal: Column) -> Column:
    """The value of a literal with a datatype, a language or quotes; other text as it is."""
    value, _ = _literal_parts(literal)
    quoted = F.regexp_extract(literal, r'^"(.*)"$', 1)
    return (
        F.when(F.contains(literal, F.lit("http://www.w3.org/2001/XMLSchema")), value)
        .when(F.endswith(literal, F.lit("@en")), F.regexp_extract(literal, r"^.(.*).@en$", 1))
        .when(literal.rlike('^".*"$'), quoted)
        .otherwise(literal)
    )


def _literal_parts(literal: Column) -> tuple[Column, Column]:
    value = F.regexp_replace(F.regexp_replace(F.split(literal, r"\^\^")[0], r'^"(.*)"$', "$1"), "-08:00$", "")
    kind = F.regexp_replace(F.coalesce(F.get(F.split(literal, r"\^\^"), F.lit(1)), F.lit("")), "^<(.*)>$", "$1")
    return value, kind


def constant_kind(c: Column) -> Column:
    """entity, class, quantity, time or string of a rendered constant, by its form alone."""
    xsd = lambda *names: "|".join(names)
    return (
        F.when(c.rlike(r"^[mg]\."), "entity")
        .when(c.rlike(r"^[a-zA-Z_]+\.[a-zA-Z_]+$"), "class")
        .when(c.rlike(rf"\^\^<http://www\.w3\.org/2001/XMLSchema#({xsd('decimal', 'integer', 'float')})>$"), "quantity")
        .when(c.rlike(rf"\^\^<http://www\.w3\.org/2001/XMLSchema#({xsd('date', 'gYear', 'gYearMonth', 'dateTime')})>$"), "time")
        .when(c.rlike(r'(@en|")$'), "string")
    )


def syntax_text(c: Column, namespace: str) -> Column:
    """A rendered constant as a syntax tree shows it: nodes as IRIs in angle brackets, literals as they are."""
    return F.when(constant_kind(c).isin("entity", "class"), F.concat(F.lit(f"<{namespace}"), c, F.lit(">"))).otherwise(c)


def syntax_value(c: Column, namespace: str) -> Column:
    """The value of a constant in a syntax tree: nodes with the namespace, numbers and times without their type, strings without their language."""
    kind = constant_kind(c)
    return (
        F.when(kind.isin("entity", "class"), F.concat(F.lit(namespace), c))
        .when(kind.isin("quantity", "time"), F.split(c, r"\^\^")[0])
        .when(kind == "string", F.regexp_replace(c, "@en$", ""))
    )


def render(kind: Column, value: Column, datatype: Column, lang: Column) -> Column:
    """A binding as text: IRIs bare, literals quoted with datatype or language."""
    quoted = F.when(value.rlike('^".*"$'), value).otherwise(F.concat(F.lit('"'), value, F.lit('"')))
    return (
        F.when(kind == "uri", value)
        .when(kind == "typed-literal", F.concat(quoted, F.lit("^^<"), datatype, F.lit(">")))
        .when(kind == "literal", F.concat(quoted, F.coalesce(F.concat(F.lit("@"), lang), F.lit(""))))
        .otherwise(value)
    )


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def numeral_triggers(question: Column) -> Column:
    """Array of COMPARE, COUNT and ARG that a question calls for.

    Comparatives and superlatives of adjectives are told by their endings (-er than, -est), not tagged.
    """
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(question), r"^[?.]+|[?.]+$", ""), F.lit(" "))
    comparative = padded.rlike(r" [a-z]{2,}er than ")
    superlative = padded.rlike(r" [a-z]{2,}(?<!int)(?<!r)est ") & ~padded.rlike(r" (west|test|best guess|guest|request|forest|interest|nest|rest) ")
    return F.array_compact(
        F.array(
            F.when(comparative | _any(padded, COMPARE_PHRASES), "COMPARE"),
            F.when(_any(padded, COUNT_PHRASES), "COUNT"),
            F.when(superlative | _any(padded, SUPERLATIVE_PHRASES), "ARG"),
        )
    )


def expand_time(t: Column, present: str = "2015-08-10") -> Column:
    """A time expression as the values to look for: a year or month with its first and last day."""
    month = F.concat(t, F.lit("-01")).try_cast("date")
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    stamp = t.rlike(r"^\d{4}-\d\d-\d\dT\d\d(:\d\d(:\d\d)?)?$")
    year = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")).try_cast("date"))
    return (
        F.when(t == "PRESENT_REF", F.array(F.lit(present)))
        .when(year.isNotNull(), F.array(t, day(year), F.concat(t, F.lit("-12-31"))))
        .when(t.rlike(r"^\d{4}-\d\d$") & month.isNotNull(), F.array(t, day(month), day(F.last_day(month))))
        .when(t.rlike(r"^\d{4}-\d\d-\d\d$") & t.try_cast("date").isNotNull(), F.array(t))
        .when(stamp, F.array(F.concat(t, F.lit("Z"))))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )


def word_ngrams(c: Column, n: int) -> Column:
    """The n-grams of an array of tokens, joined by spaces."""
    last = F.size(c) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(c, i, F.lit(n)), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def hops(query: Column) -> Column:
    """Edges and filters of a query's text."""
    return F.regexp_count(query, F.lit(r" p:|wdt:| ps:| pq:")) + F.regexp_count(F.lower(query), F.lit("filter"))


def match_form(query: Column) -> Column:
    """Query text with white space evened out, for matching."""
    return F.trim(F.regexp_replace(query, r"\s+", " "))


def direct_form(query: Column) -> Column:
    """Statement paths p:X/ps:X as their direct property."""
    return F.regexp_replace(query, r"p:(P\d+)/ps:\1\b", "wdt:$1")
