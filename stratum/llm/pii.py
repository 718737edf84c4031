"""Personal data by weak supervision, in DataFrame functions alone.

Strict patterns give the base spans; loose patterns give further candidates. On each candidate four labelers vote:
the strict pattern, a gazetteer, the words before it, and its shape. Expectation-maximisation over the counts of the
vote patterns (at most KINDS x 2**10 rows with the traits, whatever the input) estimates each labeler's reliability by kind, and a
logistic classifier of the votes and of TRAITS of the span and its surroundings is trained on the resulting soft
labels. Base spans stay; candidates that overlap none of them and reach THRESHOLD are added.

Running sums and overlaps along a text's matches are found in blocks of about the root of their number, so a text of
very many matches costs little more than its share.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Matches never overlap others of their
kind; candidates that fail a check are dropped without another try. Repeated rows are handled one by one, null ids
stay null, an empty table gives no rows, and other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, let, materialize, text_of

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Parts exclude what follows them, so possessive repeats match the same and never go back.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
DOT, GAP, HEX = r"(?:\.|\[\.\]|\(\.\)|\{\.\}|\x20?[\[(]dot[\])]\x20?)", r"[\x20.\-\xA0\u2010-\u2015]", "[0-9A-Fa-f]{1,4}"
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9.])[0-9(](?:[\x20().-]{0,3}+[0-9]){7,}+",
    # written with brackets or words for dots, or of version 6
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9])"
    rf"|(?<![0-9A-Za-z:.])(?:(?:{HEX}:){{7}}{HEX}|(?=(?:[0-9A-Fa-f]{{0,4}}:){{2,8}}[0-9A-Fa-f]{{0,4}}(?![0-9A-Za-z:]))(?:{HEX}(?::{HEX})*+)?::(?:{HEX}(?::{HEX})*+)?)(?![0-9A-Za-z:])",
    # the layouts of cards, wherever they stand in a longer run of digits
    "card": rf"(?<![0-9])(?:[0-9]{{4}}(?:{GAP}{{1,3}}+[0-9]{{4}}){{3}}|[0-9]{{4}}{GAP}{{1,3}}+[0-9]{{6}}{GAP}{{1,3}}+[0-9]{{5}}|[0-9]{{13,19}})(?![0-9])",
}
#: A run of digits in any groups, of which a card may be the first so many, up to the end of a group.
RUN, PREFIXES = rf"(?<![0-9])[0-9](?:{GAP}{{0,3}}+[0-9]){{12,}}+", (16, 15, 19, 18, 17, 14, 13)
#: Labelers' word lists, fixed values.
BEFORE = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|correo|courriel|kontakt)\b[^\n]{0,12}$",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|addr|client)\b[^\n]{0,12}$",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|karte|tarjeta|carte)\b[^\n]{0,12}$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|teléfono|téléphone)\b[^\n]{0,12}$",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|\(dot\)|\[dot\])\x20?(?:com|net|org|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"(?i)^(?!0|127\D|255\D|22[4-9][.\[({\x20]|2[34][0-9][.\[({\x20]|::1?$|fe80:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+|00)?\D?(?:1|33|34|39|44|49|7|81|86|91)",
}
SHAPE = {
    "email": r"^[A-Za-z][A-Za-z0-9._%+-]{1,63}\x20?[@(\[]",
    "ip": rf"^(?:[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}|(?=.*[0-9])(?:[0-9A-Fa-f]{{0,4}}:){{3,8}}[0-9A-Fa-f]{{0,4}})$",
    "card": rf"^(?:[0-9]{{13,19}}|[0-9]{{4}}(?:{GAP}[0-9]{{4}}){{3}}|[0-9]{{4}}{GAP}[0-9]{{6}}{GAP}[0-9]{{5}})$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}$",
}
#: Traits of a span and of what stands before it: column and pattern; fixed values.
TRAITS = (
    ("value", r"[0-9A-Za-z][\x20().\-\xA0\u2010-\u2015]+[0-9A-Za-z]"), ("value", r"^.{21,}$"), ("value", r"[+@:]"), ("before", r"[A-Za-z0-9_]$"), ("before", r"[:=(\[<\x22']\x20?$"),
    ("before", r"(?i)\b(?:order|id|no|nr|number|version|isbn|issn|page|pages|year|years|ratio|total|eur|usd|price)\b[^\n]{0,12}$"),
)
VOTES = 4
THRESHOLD = 0.9
ROUNDS = 50
#: What a span is to the labelers.
_SPANS = "array<struct<kind:int,s:int,e:int,value:string,before:string>>"


def scan(values: Column, op, kind: str = "int") -> Column:
    """Running ``op`` (associative) along an array: within blocks, then with what the blocks before it come to."""
    last = lambda a: F.get(a, F.size(a) - 1)
    with_ = lambda x, y: F.when(x.isNull(), y).otherwise(op(x, y))
    none = F.array().cast(f"array<{kind}>")
    width = lambda v: F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
    cut = lambda v: let(width(v), lambda b: F.transform(F.sequence(F.lit(0), F.size(v) - 1, b), lambda i: F.slice(v, i + 1, b)))
    inner = lambda v: F.transform(cut(v), lambda x: F.aggregate(x, none, lambda acc, y: F.array_append(acc, with_(last(acc), y))))
    bases = lambda own: F.aggregate(own, F.array(F.lit(None).cast(kind)), lambda acc, x: F.array_append(acc, with_(last(acc), last(x))))
    whole = lambda own: let(bases(own), lambda base: F.flatten(F.transform(own, lambda x, k: F.transform(x, lambda y: with_(F.get(base, k), y)))))
    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(inner(v), whole)))


def _found(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """Matches of ``pattern`` as (kind, s, e, value, before), from the matches and the gaps between them."""

    def placed(both):
        ends = scan(F.transform(both["m"], lambda x, i: F.length(F.get(both["g"], i)) + F.length(x)), lambda x, y: x + y)
        span = lambda at: lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (F.get(at, i) - F.length(x)).alias("s"), F.get(at, i).alias("e"), x.alias("value"), F.substring(F.get(both["g"], i), -40, 40).alias("before"))
        return let(ends, lambda at: F.transform(both["m"], span(at)))

    some = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.when(gate & text.rlike(pattern), let(some, placed)).otherwise(F.array().cast(_SPANS))


def _apart(spans: Column, others: Column) -> Column:
    """``spans`` that overlap none of ``others``: both in one order of starts, with the last end before and the next start
    behind of the others."""
    struct = lambda x, other: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(other).alias("o"), x.alias("x"))
    both = F.sort_array(F.concat(F.transform(others, lambda x: struct(x, True)), F.transform(spans, lambda x: struct(x, False))))
    ends = lambda a: scan(F.transform(a, lambda x: F.when(x["o"], x["e"]).otherwise(-1)), F.greatest)
    starts = lambda a: F.reverse(scan(F.reverse(F.transform(a, lambda x: F.when(x["o"], x["s"]).otherwise(1 << 30))), F.least))
    clash = lambda at: lambda x, i: x["o"] | (F.get(at["end"], i) > x["s"]) | (F.get(at["next"], i) < x["e"])
    free = lambda a: let(F.struct(ends(a).alias("end"), starts(a).alias("next")), lambda at: F.transform(F.filter(a, lambda x, i: ~clash(at)(x, i)), lambda x: x["x"]))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(both, free))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(span: Column) -> Column:
    """The contract's checks of a strict match."""
    value, digits = span["value"], _digits(span["value"])
    n = F.length(digits)
    return F.when(span["kind"] == 0, F.lit(True)).when(span["kind"] == 1, _octets(value)).when(span["kind"] == 2, _card(value)).otherwise(n.between(9, 15))


def _octets(value: Column) -> Column:
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _plausible(span: Column) -> Column:
    """What a loose candidate must pass before the labelers vote: octets or groups of an address, Luhn's sum of a card."""
    value = span["value"]
    groups = ~(value.contains("::") & value.rlike(rf"^(?:{HEX}::?){{7}}{HEX}$"))
    ip = F.when(value.contains(":"), groups).otherwise(_octets(F.regexp_replace(value, "[^0-9]+", ".")))
    return F.when(span["kind"] == 1, ip).when(span["kind"] == 2, _card(value)).otherwise(True)


def _prefix(span: Column) -> Column:
    """The span cut to the first of PREFIXES that passes Luhn's sum, with an empty value if none does."""
    cut = F.transform(F.array(*[F.regexp_extract(span["value"], rf"^[0-9](?:{GAP}{{0,3}}+[0-9]){{{n - 1}}}(?![0-9])", 0) for n in PREFIXES]), lambda v: F.when(_card(v), v))
    value = lambda v: F.struct(span["kind"].alias("kind"), span["s"].alias("s"), (span["s"] + F.length(v)).cast("int").alias("e"), v.alias("value"), span["before"].alias("before"))
    return let(F.coalesce(F.get(F.filter(cut, lambda v: v.isNotNull()), F.lit(0)), F.lit("")), value)


def _by_kind(span: Column, lists: dict[str, str], on: str) -> Column:
    out = F.lit(False)
    for i, k in enumerate(KINDS):
        out = F.when(span["kind"] == i, span[on].rlike(lists[k])).otherwise(out)
    return out


def _voted(span: Column, strict: Column) -> Column:
    """(kind, s, e, v): the four votes and the traits, one bit each."""
    bits = [strict, _by_kind(span, GAZETTEER, "value"), _by_kind(span, BEFORE, "before"), _by_kind(span, SHAPE, "value"), *[span[on].rlike(p) for on, p in TRAITS]]
    total = F.lit(0)
    for i, b in enumerate(bits):
        total = total + F.when(b, 1 << i).otherwise(0)
    return F.struct(span["kind"].alias("kind"), span["s"].alias("s"), span["e"].alias("e"), total.alias("v"))


def _arrays(t: Column) -> tuple[Column, Column]:
    """Strict spans that pass their checks, and loose candidates, of a text."""
    digit, at = t.rlike("[0-9]"), t.contains("@")
    gate = {"email": at, "ip": digit, "card": digit, "phone": t.contains("+")}
    strict = F.flatten(F.array(*[F.filter(_found(t, k, STRICT[k], gate[k]), _valid) for k in KINDS]))
    gate = {"email": at | t.contains("(at)") | t.contains("[at]"), "ip": digit & (t.contains(".") | t.contains("dot")) | t.contains("::") | t.rlike(f"{HEX}:{HEX}:"), "card": digit, "phone": digit}
    loose = F.flatten(F.array(*[F.filter(_found(t, k, LOOSE[k], gate[k]), _plausible) for k in KINDS]))
    runs = F.filter(F.transform(_found(t, "card", RUN, digit), _prefix), lambda x: x["value"] != "")
    # of a kind no two overlap: a prefix counts where no layout was found
    card = lambda c: F.filter(c["l"], lambda y: y["kind"] == KINDS.index("card"))
    return strict, let(F.struct(loose.alias("l"), runs.alias("r")), lambda c: F.concat(c["l"], let(card(c), lambda y: _apart(c["r"], y))))


def _with_candidates(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``__base`` and ``__more``: arrays of (kind, s, e, v)."""
    strict, loose = _arrays(F.col(text))
    both = let(F.struct(strict.alias("base"), loose.alias("loose")), lambda c: F.struct(F.transform(c["base"], lambda x: _voted(x, F.lit(True))).alias("base"), F.transform(_apart(c["loose"], c["base"]), lambda x: _voted(x, F.lit(False))).alias("more")))
    return rows.withColumn("__both", both).withColumns({"__base": F.col("__both.base"), "__more": F.col("__both.more")}).drop("__both")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, more): arrays of (kind, s, e, v); written once, the text is read in one pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return materialize(_with_candidates(rows, "t").select("doc_id", F.col("__base").alias("base"), F.col("__more").alias("more")), "pii")


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]]) -> dict[int, tuple[float, list[float], list[float]]]:
    """By kind (prior, P(vote | personal), P(vote | not)) by expectation-maximisation over (kind, votes, count).

    Counts are smoothed, and a vote is never taken as evidence against: this keeps the classes from changing places."""
    out = {}
    for kind in range(len(KINDS)):
        own = [(v[:VOTES], n) for k, v, n in patterns if k == kind]
        prior, yes, no = 0.5, [0.9, 0.7, 0.5, 0.8], [0.1, 0.3, 0.05, 0.2]
        for _ in range(ROUNDS if own else 0):
            soft = [(v, n, _posterior(v, prior, yes, no)) for v, n in own]
            pos, neg = sum(n * p for _, n, p in soft) + 2, sum(n * (1 - p) for _, n, p in soft) + 2
            prior = min(0.95, max(0.05, pos / (pos + neg)))
            yes = [min(0.99, (sum(n * p for v, n, p in soft if v[j]) + 1) / pos) for j in range(VOTES)]
            no = [max(0.01, min(y, (sum(n * (1 - p) for v, n, p in soft if v[j]) + 0.2) / neg)) for j, y in enumerate(yes)]
        out[kind] = (prior, yes, no)
    return out


def _posterior(votes: tuple[int, ...], prior: float, yes: list[float], no: list[float]) -> float:
    a = math.log(prior) - math.log(1 - prior)
    for v, y, n in zip(votes, yes, no):
        a += math.log(y if v else 1 - y) - math.log(n if v else 1 - n)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a))))


def train(patterns: list[tuple[int, tuple[int, ...], int]]) -> dict[int, list[float]]:
    """Weights (bias, one for each vote and trait) of the final classifier by kind, fitted to the soft labels by gradient
    steps. The labels come from the votes alone: a trait's weight is what it tells about them across the corpus."""
    out, width = {}, VOTES + len(TRAITS)
    for kind, (prior, yes, no) in reliabilities(patterns).items():
        own = [(v, n, _posterior(v[:VOTES], prior, yes, no)) for k, v, n in patterns if k == kind]
        total, w = sum(n for _, n, _ in own), [0.0] * (width + 1)
        for _ in range(400 if own else 0):
            grad = [0.01 * x for x in w]
            for v, n, p in own:
                x = (1, *v)
                q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
                for j, b in enumerate(x):
                    grad[j] += n / total * (q - p) * b
            w = [a - 1.5 * g for a, g in zip(w, grad)]
        out[kind] = w if own else [-30.0] + [0.0] * width
    return out


def fitted(found: DataFrame) -> dict[int, list[float]]:
    """The classifier's weights from ``candidates``."""
    voted = found.select(F.explode(F.concat("base", "more")).alias("x")).groupBy("x.kind", "x.v").agg(F.count(F.lit(1)).alias("n"))
    rows = voted.collect()  # at most KINDS x 2 ** (votes and traits) rows
    return train(sorted((r.kind, tuple(r.v >> i & 1 for i in range(VOTES + len(TRAITS))), r.n) for r in rows))


def _accepted(base: Column, more: Column, weights: dict[int, list[float]]) -> Column:
    """Base spans, and others the classifier accepts, by kind and start."""

    def sure(x):
        out = F.lit(False)
        for kind, (b, *w) in weights.items():
            logit = F.lit(b)
            for j, weight in enumerate(w):
                logit = logit + F.when(x["v"].bitwiseAND(F.lit(1 << j)) != 0, weight).otherwise(0.0)
            out = F.when(x["kind"] == kind, logit >= math.log(THRESHOLD / (1 - THRESHOLD))).otherwise(out)
        return out

    return F.sort_array(F.transform(F.concat(base, F.filter(more, sure)), _place))


def _place(x: Column) -> Column:
    return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of ``candidates``."""
    return found.select("doc_id", F.transform("base", _place).alias("base"), _accepted(F.col("base"), F.col("more"), fitted(found)).alias("spans"))


def _joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(column), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    rows = spans(candidates(docs, id_col, text_col))
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; a null text stays null.

    The classifier is trained first, from counts; the spans are then found and replaced where the text is, so no text
    is shuffled. Overlapping spans become one, named after the first."""
    weights = fitted(candidates(docs.withColumn("__id", F.lit(None).cast("long")), "__id", text_col))
    rows = _with_candidates(docs.withColumn("__t", text_of(text_col)), "__t")
    spans = F.transform(_accepted(F.col("__base"), F.col("__more"), weights), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    masked = F.when(F.col(text_col).isNull(), F.col(text_col)).when(F.size("__spans") == 0, F.col("__t")).otherwise(_replaced(F.col("__t"), F.col("__spans")))
    return rows.withColumn("__spans", F.sort_array(spans)).withColumn(text_col, masked).drop("__t", "__base", "__more", "__spans")


def _replaced(t: Column, spans: Column) -> Column:
    """``t`` with each of ``spans`` (s, e, kind; sorted, some) replaced by its kind; the text is cut by blocks of spans."""
    name = lambda x: F.concat(F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"])), F.lit("]"))
    ends = scan(F.transform(spans, lambda x: x["e"]), F.greatest)
    # the first of each run of overlapping spans, with the end of the run before it; a run ends where the next begins
    heads = lambda at: F.filter(F.transform(spans, lambda x, i: F.struct(F.coalesce(F.get(at, i - 1), F.lit(0)).alias("p"), x["s"].alias("s"), x["kind"].alias("kind"))), lambda x: x["s"] >= x["p"])
    width = lambda h: F.ceil(F.sqrt(F.size(h).cast("double"))).cast("int")
    cut = lambda h: let(width(h), lambda b: F.transform(F.sequence(F.lit(0), F.size(h) - 1, b), lambda i: F.slice(h, i + 1, b)))

    def block(own):
        first, last = F.get(own, F.lit(0))["p"], F.get(own, F.size(own) - 1)["s"]
        piece = F.substring(t, first + 1, last - first)
        return let(piece, lambda part: F.array_join(F.transform(own, lambda x: F.concat(F.substring(part, x["p"] - first + 1, x["s"] - x["p"]), name(x))), ""))

    tail = lambda at: F.substring(t, F.get(at, F.size(at) - 1) + 1, F.length(t))
    return let(ends, lambda at: F.concat(F.array_join(F.transform(let(heads(at), cut), block), ""), tail(at)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
