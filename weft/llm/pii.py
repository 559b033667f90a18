"""Personal data by weak supervision (operator 1), Spark functions only.

Regular expressions propose spans of each kind.  Five labelers vote on every
span (+1, -1, or 0 to abstain), each on something else: its strict form, its
check digits or bounds, gazetteers, context words before it, and its edges.  A
labeler abstains where a kind gives it nothing of its own to look at.  Votes are
counted by pattern over all documents: that table has at most
len(KINDS) * 3**5 * 16 rows, whatever the input.  Expectation-maximisation on it
gives each labeler's reliability, in all and by kind (drawn towards that in all
by SHRINK pseudo-counts), and each pattern's probability, and a logistic span
classifier is fitted to those soft labels.  The classifier, a few numbers, is
then applied as an expression.  Labelers are taken to be no worse than chance,
which keeps the two classes from changing names.

Spans of the base kinds that pass their check always stay; others stay if the
classifier accepts them.  Texts are searched once: the proposals are written to
the shared folder, one narrow row per document (with the document, where texts
are masked).  The only shuffle is that of the counts, summed in each task first.

Null texts count as empty, and stay null where they are masked.  Every row gets
a row, also where ids repeat or are null; columns are taken by place, so that no
name can clash; other columns are not read, or kept as they are.  Without any
proposal the classifier is empty and nothing is added.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import named, written
from weft.llm.spans import spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "hidden_email", "local_phone", "ssn", "iban", "name")
LABELERS = ("form", "check", "gazetteer", "context", "edges")

_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra"
#: Common given names of the four languages.
_GIVEN = "|".join("""
Adam Alan Albert Alejandro Alexander Alfred Alice Amy Ana Andrea Andreas Andrew Angela Anna Anne Antoine Antonio Arthur Barbara Beatriz
Benjamin Bernard Birgit Brian Bruno Camille Carlos Carmen Catherine Charles Charlotte Christian Christine Christopher Claire Claudia Cristina
Daniel David Deborah Diego Dieter Donald Dorothy Eduardo Edward Elena Elizabeth Emily Emma Eric Eva Fernando Francisco Frank Friedrich Gabriel
George Gerhard Gloria Guillaume Hannah Hans Heike Heinrich Helen Helga Henri Henry Ines Ingrid Isabel Jacques James Jan Javier Jean Jennifer
Jessica Joan John Jonas Jorge Jose Joseph Juan Julia Julie Julien Karen Karin Karl Katharina Kevin Klaus Kurt Laura Lea Lena Leon Linda Lisa
Louis Louise Lucas Lucia Luis Lukas Manuel Margaret Maria Marie Mario Mark Marta Martin Mary Matthew Max Michael Michel Miguel Monika Nancy
Nathalie Nicolas Nicole Olivier Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philippe Pierre Rafael Raquel Raul Renate Richard Robert
Roberto Ronald Rosa Ruth Sabine Sandra Sara Sarah Sergio Sofia Sophie Stefan Stephanie Steven Susan Sylvie Teresa Thomas Ursula Uwe Werner
William Wolfgang Yves
""".split())
#: Top-level domains in wide use.
_TLDS = """
com org net edu gov mil int io info biz name pro app dev ai co me tv eu de fr es uk us ch at it nl be lu dk se no fi is ie pt pl cz sk hu ro bg
gr hr si rs ua ru by ee lv lt tr il ae sa eg ma tn za ng ke in pk bd lk cn hk tw jp kr sg my th vn id ph au nz ca mx br ar cl pe ve uy ec
""".split()
_POSITIVE = r"mail|contact|kontakt|correo|courriel|tel|phone|call|fax|mobil|server|host|\bip\b|addr|card|visa|credit|karte|tarjeta|carte|konto|account|iban|ssn|social|token|secret|passw|\bkey\b|name|\bmr\b|\bdr\b"
_NEGATIVE = r"version|\bv\.?$|isbn|issn|order|figure|fig\.|table|page|chapter|section|sha|md5|commit"
#: Pseudo-counts that draw a kind's reliabilities to those of all kinds.
SHRINK = 20.0

_LOCAL = "A-Za-z0-9._%+-"
#: Each kind's proposals.  The base ones find exactly the leftmost matches of
#: their contract: possessive runs only leave out retries that cannot succeed,
#: and a first look at one character only spares attempts that would fail.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<=[=: \"'])(?<=(?:[tT]oken|[sS]ecret|[pP]assword|api_key|API_KEY|apikey) ?[=:] ?[\"']?)[A-Za-z0-9_+/=-]{8,}+|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+",
    "hidden_email": r"[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}+){1,20}+",
    "local_phone": r"(?=[(0-9])(?<![0-9+()] )(?<![0-9+()./-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?=[A-Z])\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"(?=[A-Z][a-z]*\.? [A-Z][a-z])\b(?:(?:{_TITLES})\.? [A-Z][a-z]+|(?:{_GIVEN}) [A-Z][a-z]+)\b",
}
#: A kind is looked for where one of these occurs; None: everywhere.
GATES = {
    "email": ("@",), "phone": ("+",), "hidden_email": ("[at]", "(at)"),
    "secret": ("oken", "ecret", "assword", "api_key", "API_KEY", "apikey", "AKIA", "ghp_", "sk-"),
}


@dataclass
class Model:
    """Reliabilities by labeler and by (kind, labeler), and the span classifier's
    weights."""

    right: list[float] = field(default_factory=list)  # P(+1 | personal, voted)
    wrong: list[float] = field(default_factory=list)  # P(+1 | not personal, voted)
    own: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)  # by kind
    votes: list[float] = field(default_factory=list)
    length: list[float] = field(default_factory=list)
    digits: list[float] = field(default_factory=list)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, c: Column) -> Column:
    """The base kinds' check."""
    if kind == "ip":
        return F.forall(F.split(c, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return luhn(_digits(c))
    if kind == "phone":
        return F.length(_digits(c)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    no = ~yes if no is None else no
    return F.when(yes, 1).when(no, -1).otherwise(0)


def mod97(c: Column) -> Column:
    """Whether an account number passes its check digits: the first four
    characters go last, letters count from 10, and the rest by 97 is 1."""
    plain = F.regexp_replace(c, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code < 65, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _labels(kind: str, c: Column, before: Column, edges: Column) -> list[Column]:
    """Five votes on a proposed span; a kind has only labelers that look at
    something the others and its own pattern don't settle."""
    none = F.lit(0)
    matches = lambda p: F.rlike(c, F.lit(p))
    last = F.element_at(F.split(F.lower(c), r"[. \])]+"), -1)
    kinds_of_characters = F.size(F.array_distinct(F.split(c, "")))
    form = {
        "email": _vote(matches("^[A-Za-z0-9]") & ~matches(r"[._%+-]{2}|[._%+-]@")), "ip": _vote(~matches(r"(?:^|\.)0[0-9]")),
        "card": _vote(matches("^(?:[0-9]{15,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?)$")), "phone": _vote(matches(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]")),
        "secret": _vote(matches("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")), "hidden_email": _vote(matches(r"dot[\])]")), "local_phone": _vote(matches(r"^\([0-9]{3}\) |([.-]).{3}\1")),
        "iban": _vote(matches("^(?:[^ ]+|[^ ]{4}(?: [^ ]{4})+(?: [^ ]{1,3})?)$")), "name": _vote(matches(rf"^(?:{_TITLES})\b"), F.lit(False)),
    }.get(kind, none)
    check = {
        "email": _vote(matches(r"\.[A-Za-z]{2,}$") & ~matches(r"[@.]-|-\.|@.*[A-Za-z0-9-]{64}")), "ip": _vote(passes("ip", c)), "card": _vote(passes("card", c)), "phone": _vote(passes("phone", c)),
        "secret": _vote(kinds_of_characters >= 10, kinds_of_characters < 6), "ssn": _vote(~matches("^(?:000|666|9)|-00-|-0000$")),
        "local_phone": _vote(~matches(r"^\(?[01]|^.{3,5}[ .-][01]")), "iban": _vote(mod97(c)),
    }.get(kind, none)
    gazetteer = {
        "email": _vote(last.isin(_TLDS)), "hidden_email": _vote(last.isin(_TLDS)),
        "ip": _vote(~matches(r"^(?:0|127|22[4-9]|2[3-5][0-9])\.")),
        "card": _vote(matches("^[3-6]"), matches("^0")), "phone": _vote(matches(r"^\+[1-9]")),
        "name": _vote(matches(rf"\b(?:{_GIVEN})\b"), F.lit(False)), "iban": _vote(matches("^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)")),
    }.get(kind, none)
    context = _vote(F.rlike(before, F.lit(_POSITIVE)), F.rlike(before, F.lit(_NEGATIVE)))
    return [form, check, gazetteer, context, _vote(edges)]


def _proposed(kind: str, text: Column, hits: Column) -> Column:
    """array<struct<kind, start, end, valid, votes, length, digits>> of one kind."""

    def made(s: Column) -> Column:
        before = F.lower(F.substr(text, F.greatest(s["start"] - 40, F.lit(0)) + 1, F.least(s["start"], F.lit(40))))
        nearby = F.concat(F.when(s["start"] > 0, F.substr(text, s["start"], F.lit(1))).otherwise(" "), F.substr(text, s["end"] + 1, F.lit(1)))
        n = s["end"] - s["start"]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (passes(kind, s["text"]) if kind in BASE else F.lit(False)).alias("valid"),
            F.array(*[v.cast("int") for v in _labels(kind, s["text"], before, ~F.rlike(nearby, F.lit("[A-Za-z0-9]")))]).alias("votes"),
            F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3).alias("length"),
            F.floor(3 * F.length(_digits(s["text"])) / n).cast("int").alias("digits"),
        )

    return F.transform(spans(text, F.lit(PATTERNS[kind]), hits), made)


def proposals(plain: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep, found) for each row: all kinds' proposals.  Each pattern goes over
    a text once; where it matches, once more for the pieces between."""
    base = plain.select(*dict.fromkeys([*keep, text_col])).withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("__text")
    empty = F.array().cast("array<struct<kind: int, start: bigint, end: bigint, valid: boolean, votes: array<int>, length: int, digits: int>>")

    def hits(kind: str) -> Column:
        got = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        gates = [F.contains(text, F.lit(g)) for g in GATES.get(kind, ())]
        return F.when(functools.reduce(lambda a, b: a | b, gates), got) if gates else got

    found = base.select("*", *[hits(k).alias(f"__{k}") for k in KINDS])
    made = [F.when(F.size(f"__{k}") > 0, _proposed(k, text, F.col(f"__{k}"))).otherwise(empty) for k in KINDS]
    return found.select(*keep, F.concat(*made).alias("found"))


def fit(counts: list[tuple[int, tuple[int, ...], int, int, int]], rounds: int = 40, steps: int = 300) -> Model:
    """EM over (kind, votes, length, digits, count) rows, then the classifier.

    A labeler that votes is right with its own probability in each class; the
    share of personal spans is estimated by kind.  Starting from labelers that
    are right four times in five keeps the classes from changing names."""
    k = len(LABELERS)
    m = Model([0.8] * k, [0.2] * k)
    share = [0.5] * len(KINDS)
    soft = [0.0] * len(counts)
    for _ in range(rounds):
        for at, (kind, votes, _, _, _) in enumerate(counts):
            logit = math.log(share[kind] / (1 - share[kind]))
            for j, v in enumerate(votes):
                if v:
                    right, wrong = m.own.get((kind, j), (m.right[j], m.wrong[j]))
                    a, b = (right, wrong) if v > 0 else (1 - right, 1 - wrong)
                    logit += math.log(a / b)
            soft[at] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
        for j in range(k):
            votes_of = [(c[0], c[4], p, c[1][j]) for c, p in zip(counts, soft, strict=True) if c[1][j]]

            def rate(rows: list, before: float, weight: float, personal: bool) -> float:
                """The share of +1 among the votes on one class."""
                each = [(n * (p if personal else 1 - p), v) for _, n, p, v in rows]
                return (weight * before + math.fsum(w for w, v in each if v > 0)) / (weight + math.fsum(w for w, _ in each))

            m.right[j] = min(0.99, max(0.5, rate(votes_of, 0.8, 10, True)))
            m.wrong[j] = min(0.5, max(0.01, rate(votes_of, 0.2, 10, False)))
            for kind in {v[0] for v in votes_of}:
                own = [v for v in votes_of if v[0] == kind]
                m.own[kind, j] = (min(0.99, max(0.5, rate(own, m.right[j], SHRINK, True))), min(0.5, max(0.01, rate(own, m.wrong[j], SHRINK, False))))
        for kind in range(len(KINDS)):
            own = [(c[4], p) for c, p in zip(counts, soft, strict=True) if c[0] == kind]
            share[kind] = min(0.98, max(0.02, (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))))
    width = len(KINDS) + k + 4 + 4
    w, total = [0.0] * width, sum(c[4] for c in counts) or 1
    for _ in range(steps):
        slope = [-1e-3 * x for x in w]
        for (kind, votes, length, digits, n), p in zip(counts, soft, strict=True):
            on = [(kind, 1), *((len(KINDS) + j, v) for j, v in enumerate(votes) if v), (len(KINDS) + k + length, 1), (len(KINDS) + k + 4 + digits, 1)]
            z = sum(w[i] * x for i, x in on)
            e = n / total * (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for i, x in on:
                slope[i] += e * x
        w = [x + 2.0 * s for x, s in zip(w, slope, strict=True)]
    m.bias = dict(zip(KINDS, w, strict=False))
    m.votes, m.length, m.digits = w[len(KINDS) : len(KINDS) + k], w[len(KINDS) + k : -4], w[-4:]
    return m


def _weights(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def accepted(model: Model, s: Column) -> Column:
    """Whether a proposal stays."""
    z = F.element_at(_weights([model.bias[k] for k in KINDS]), s["kind"] + 1)
    z = z + F.element_at(_weights(model.length), s["length"] + 1) + F.element_at(_weights(model.digits), s["digits"] + 1)
    for j, w in enumerate(model.votes):
        z = z + F.lit(float(w)) * F.element_at(s["votes"], j + 1)
    return s["valid"] | ((s["kind"] >= len(BASE)) & (z > 0))


def learn(found: DataFrame) -> Model:
    """The model of proposals()' rows."""
    one = F.col("s")
    rows = found.select(F.explode("found").alias("s")).groupBy(one["kind"].alias("kind"), one["votes"].alias("votes"), one["length"].alias("length"), one["digits"].alias("digits")).count().collect()
    return fit(sorted((r["kind"], tuple(r["votes"]), r["length"], r["digits"], r["count"]) for r in rows))


def kept(found: Column, model: Model) -> Column:
    """array<struct<kind: string, start, end: bigint, base: boolean>> of the
    proposals that stay, by kind, then start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(F.filter(found, lambda s: accepted(model, s)), lambda s: F.struct(s["kind"].alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["valid"].alias("base"))))
    return F.transform(order, lambda s: F.struct(F.element_at(names, s["at"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id_col, spans) as kept() has them."""
    found = written(proposals(df.select(named(id_col).alias("c0"), named(text_col).alias("c1")), "c1", ["c0"]))
    return found.select(F.col("c0").alias(id_col), kept(F.col("found"), learn(found)).alias("spans"))


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span of text_col replaced by its kind in brackets.  Rows are
    written once with their proposals, so that no text is searched twice."""
    columns, at = [f"c{i}" for i in range(len(df.columns))], df.columns.index(text_col)
    found = written(proposals(df.toDF(*columns), columns[at], columns))
    out = found.withColumn("__spans", F.when(F.size("found") > 0, kept(F.col("found"), learn(found))))
    text = F.when(F.size("__spans") > 0, masked(F.col(columns[at]), F.col("__spans"))).otherwise(F.col(columns[at]))
    return out.select(*[text if i == at else F.col(c) for i, c in enumerate(columns)]).toDF(*df.columns)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, found: Column) -> Column:
    """text with each span replaced by its kind in brackets; of spans that
    overlap, the first (at one start, the longest) counts."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct((-s["minus_end"]).alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out"))).otherwise(acc)

    done = F.aggregate(order, none, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, F.length(text) + F.lit(0)))), ""))
    return F.when(F.size(found) > 0, done).otherwise(text)
