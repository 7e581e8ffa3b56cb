"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans: the strict ones of four kinds, and looser ones (addresses spelled with "at" and
"dot", phone numbers without a country code, short card numbers, IPv6).  Labelers vote on each span:
for, against or not at all.  How often each combination of votes and features occurs over all documents
is a small table whose size depends on the labelers alone; expectation-maximisation on it estimates the
labelers' reliabilities and a probability for each combination, and a logistic classifier over the span's
features is fitted to those.  Strict spans always stand; the classifier decides on the loose ones.

Spans are found in linear time: the lengths of the stretches between matches (``split``) and of the
matches (``regexp_extract_all``) add up to the offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.runtime import unclash

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds.  Possessive repeats and look-behinds change no match: a
# run that fails from its start fails from inside, and \G lets a match begin where the last one ended.
_LOCAL = "A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9+])(?<![0-9][ -])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![ -]?[0-9])",
    "phone": r"(?<![0-9+)])(?<![0-9][ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![.-]?[0-9])",
}
#: A text without this has no span of the pattern: a cheap test before the pattern is tried.
NEEDS = {("email", True): "@", ("email", False): "at", ("ip", False): ":", ("phone", True): "+"}

# Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "us", "ch", "at")
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
FOR_WORDS = {
    "email": "mail|contact|kontakt|correo|courriel|write|reach",
    "ip": r"\bip\b|address|server|host|login|client|adresse",
    "card": "card|visa|master|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|cell|fax|anruf|llam|appel",
}
AGAINST_WORDS = r"version|isbn|issn|order|ticket|serial|section|release|build|doi"
CONTEXT = 32


def _matches(text: Column, pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(F.expr("array()").cast("array<string>")) if needs else found


def _located(text: Column, matches: Column, pattern: str) -> Column:
    """Array of (at, size, m): the offset in code points, length and text of each match."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    empty = F.expr("named_struct('end', 0, 'out', cast(array() as array<struct<at:int,size:int,m:string>>))")

    def step(acc: Column, x: Column) -> Column:
        at = acc["end"] + x["g"]
        size = F.length(x["m"])
        return F.struct((at + size).alias("end"), F.array_append(acc["out"], F.struct(at.alias("at"), size.alias("size"), x["m"].alias("m"))).alias("out"))

    nothing = F.expr("cast(array() as array<struct<at:int,size:int,m:string>>)")
    return F.when(F.size(matches) > 0, F.aggregate(pairs, empty, step, lambda a: a["out"])).otherwise(nothing)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a digit string of at most 19 digits holds."""
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), worth), F.lit(0), lambda a, b: a + b)
    return (total % 10 == 0) & (F.length(back) > 0)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit("-")).when(yes, F.lit("+")).otherwise(F.lit("0"))


def _votes(kind: str, strict: bool, text: Column, s: Column) -> Column:
    """One character per labeler: shape, gazetteer or checksum, context, boundary, variety."""
    m, at, end = s["m"], s["at"], s["at"] + s["size"]
    before = F.lower(F.substring(text, F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT))))
    after = F.substring(text, end + 1, F.lit(1))
    digits = _digits(m)
    if kind == "email":
        last = F.lower(F.element_at(F.split(F.regexp_replace(m, r" ?[\[(]dot[\])] ?", "."), r"\."), -1))
        gazette = _vote(last.isin(*DOMAINS), last.rlike("[0-9]"))
    elif kind == "ip" and strict:
        first = F.coalesce(F.element_at(F.split(m, r"\."), 1).try_cast("int"), F.lit(0))
        gazette = _vote(first.between(1, 223), (first == 0) | (first >= 240))
    elif kind == "ip":
        gazette = _vote(F.contains(m, F.lit(":")), F.lit(False))
    elif kind == "card":
        issued = digits.rlike("^(?:" + "|".join(CARD_ISSUERS) + ")")
        good = _luhn(F.substring(digits, 1, 19))
        gazette = _vote(good & issued, ~good)
    else:
        gazette = _vote(m.rlike(r"^(?:\+[1-9]|\(?[2-9])"), digits.rlike("^0+$"))
    context = _vote(before.rlike(FOR_WORDS[kind]), before.rlike(AGAINST_WORDS))
    edge = _vote(F.lit(True), before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]"))
    variety = _vote(F.length(F.array_join(F.array_distinct(F.split(m, "")), "")) >= 5, m.rlike(r"([0-9])[ .-]?\1[ .-]?\1[ .-]?\1[ .-]?\1[ .-]?\1"))
    shape = F.lit("+" if strict else "0")
    return F.concat(shape, gazette, context, edge, variety)


def _size_class(kind: str, s: Column) -> Column:
    return F.when(s["size"] < 12, F.lit("s")).when(s["size"] < 20, F.lit("m")).otherwise(F.lit("l"))


def candidates(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: array of (kind, strict, at, end, sign) where sign holds the votes and the size class."""
    text, *own = unclash(docs, "text__", *(f"m{i}_{k}" for k in KINDS for i in (0, 1)), *(f"s{i}_{k}" for k in KINDS for i in (0, 1)))
    names = dict(zip([(x, i, k) for x in "ms" for k in KINDS for i in (0, 1)], own, strict=True))
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    t = F.col(text)
    both = [(k, i, (LOOSE, STRICT)[i][k]) for k in KINDS for i in (0, 1)]
    df = df.withColumns({names["m", i, k]: _matches(t, p, NEEDS.get((k, bool(i)))) for k, i, p in both})

    def spans(k: str, i: int, p: str) -> Column:
        found = _located(t, F.col(names["m", i, k]), p)
        if i:
            return F.filter(found, lambda s: _valid(k, s["m"]))
        return found

    df = df.withColumns({names["s", i, k]: spans(k, i, p) for k, i, p in both})

    def described(k: str, i: int) -> Column:
        return F.transform(
            F.col(names["s", i, k]),
            lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), F.lit(bool(i)).alias("strict"), s["at"].alias("at"), (s["at"] + s["size"]).alias("end"), F.concat(_votes(k, bool(i), t, s), _size_class(k, s)).alias("sign")),
        )

    every = F.concat(*(described(k, i) for k, i, _ in both))
    empty = F.expr("cast(array() as array<struct<kind:int,strict:boolean,at:int,end:int,sign:string>>)")
    some = F.lit(False)
    for k, i, _ in both:
        some = some | (F.size(F.col(names["s", i, k])) > 0)
    return df.withColumn(out, F.when(some, every).otherwise(empty)).select(*docs.columns, out)


@dataclass(frozen=True)
class SpanModel:
    """Labeler reliabilities and the weights of the span classifier."""

    reliability: dict[tuple[int, int, str], tuple[float, float]]  # (kind, labeler, vote) -> P(vote | real), P(vote | not)
    prior: dict[int, float]
    weights: dict[tuple, float]

    def features(self, kind: int, sign: str) -> list[tuple]:
        return [("kind", kind), *(("vote", j, v) for j, v in enumerate(sign[:-1])), ("size", kind, sign[-1])]

    def accepts(self, kind: int, sign: str) -> bool:
        return sum(self.weights.get(f, 0.0) for f in self.features(kind, sign)) > 0


def fit(counts: list[tuple[int, str, int]], rounds: int = 50) -> SpanModel:
    """Expectation-maximisation and then logistic regression on (kind, sign, number of spans).

    Labelers start out trusted (a vote for is likelier on real data), which fixes which class is which.
    """
    labelers = len(counts[0][1]) - 1 if counts else 0
    start = {"+": (0.7, 0.2), "0": (0.25, 0.3), "-": (0.05, 0.5)}
    rel = {(k, j, v): start[v] for k in range(len(KINDS)) for j in range(labelers) for v in "+0-"}
    prior = dict.fromkeys(range(len(KINDS)), 0.5)
    post: dict[tuple[int, str], float] = {}
    for _ in range(rounds):
        for kind, sign, _n in counts:
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, v in enumerate(sign[:-1]):
                yes, no = yes + math.log(rel[kind, j, v][0]), no + math.log(rel[kind, j, v][1])
            post[kind, sign] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        for k in range(len(KINDS)):
            mine = [(s, n, post[k, s]) for kind, s, n in counts if kind == k]
            real, total = sum(n * p for _, n, p in mine), sum(n for _, n, _ in mine)
            prior[k] = (real + 1) / (total + 2)
            for j in range(labelers):
                for v in "+0-":
                    a = sum(n * p for s, n, p in mine if s[j] == v)
                    b = sum(n * (1 - p) for s, n, p in mine if s[j] == v)
                    # the starting values count as ten observations
                    rel[k, j, v] = ((a + 10 * start[v][0]) / (real + 10), (b + 10 * start[v][1]) / (total - real + 10))
    weights: dict[tuple, float] = {}
    model = SpanModel(rel, prior, weights)
    rows = [(model.features(k, s), math.log1p(n), post[k, s]) for k, s, n in counts]
    scale = sum(n for _, n, _ in rows) or 1.0
    for _ in range(400):
        grad: dict[tuple, float] = {}
        for fs, n, p in rows:
            z = sum(weights.get(f, 0.0) for f in fs)
            err = (p - 1 / (1 + math.exp(max(-50.0, min(50.0, -z))))) * n / scale
            for f in fs:
                grad[f] = grad.get(f, 0.0) + err
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) * 0.9995 + 2.0 * g
    return model


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Fits the model on the votes over all of ``docs``; without candidates its weights are empty and no loose span counts.

    Null and empty texts have no candidates; rows that repeat vote each for itself.
    What comes to the driver is one row for each kind and combination of votes that occurs: at most
    4 x 3**5 x 3 rows for any corpus.
    """
    (out,) = unclash(docs, "found")
    found = candidates(docs.select(text_col), text_col, out).select(F.explode(out).alias("c"))
    rows = found.groupBy("c.kind", "c.sign").count().collect()
    return fit(sorted((r[0], r[1], r[2]) for r in rows))


def detect(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None, out: str = "pii_spans") -> DataFrame:
    """The columns of ``docs``, and ``out``: array of (kind, base, start, end), by kind as listed, then start.

    Offsets are code points, the end exclusive.  Null and empty texts have no spans; repeated rows are
    judged alike; ``out`` gets trailing underscores if its name is taken.  Without a model one is trained
    on ``docs`` first.  A loose span counts when the classifier accepts it and no strict span of its kind
    overlaps it.
    """
    model = model or train(docs, text_col)
    raw, final = unclash(docs, "pii_candidates", out)
    df = candidates(docs, text_col, raw)
    score = lambda c: sum(
        (
            F.when(c["kind"] == f[1], F.lit(w))
            if f[0] == "kind"
            else F.when(F.substring(c["sign"], f[1] + 1, 1) == f[2], F.lit(w))
            if f[0] == "vote"
            else F.when((c["kind"] == f[1]) & (F.substring(c["sign"], -1, 1) == f[2]), F.lit(w))
        ).otherwise(0.0)
        for f, w in sorted(model.weights.items(), key=str)
    ) + F.lit(0.0)
    strict = F.filter(F.col(raw), lambda c: c["strict"])
    clear = lambda c: ~F.exists(strict, lambda b: (b["kind"] == c["kind"]) & (b["at"] < c["end"]) & (c["at"] < b["end"]))
    loose = F.filter(F.col(raw), lambda c: ~c["strict"] & (score(c) > 0) & clear(c))
    plain = lambda a: F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["at"].alias("start"), c["end"].alias("end"), c["strict"].alias("base")))
    empty = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,base:boolean>>)")
    spans = F.when(F.size(F.col(raw)) > 0, F.array_sort(plain(F.concat(strict, loose)))).otherwise(empty)
    return df.withColumn(final, spans).select(*docs.columns, final)


def spell(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets; overlapping spans become one.

    Of overlapping spans the first gives the kind, the earlier listed where two begin together.  Null and empty
    texts stay as they are; rows that repeat change alike; names of columns do not matter.
    """
    found = detect(docs, text_col, model)
    spans = found.columns[-1]
    t = F.col(text_col)
    by_start = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    name = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.get(name, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_start, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    return found.withColumn(text_col, F.when(F.size(F.col(spans)) > 0, done).otherwise(t)).select(*docs.columns)
