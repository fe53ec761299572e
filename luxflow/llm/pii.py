"""Personal data by weak supervision, in DataFrame expressions only.

Strict patterns give the base spans. They, and looser candidates, are voted on by
labelers (pattern and check digits, gazetteers, context words, borders, variety of
characters). Expectation-maximisation on the table of vote patterns estimates each
labeler's reliability, and the posteriors train a logistic span classifier, whose
weights become literals of the final expression. Candidates that it is sure of join the
base spans.

The vote patterns are a table whose size is bounded by the labelers, not the input;
only that table reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Of runs that hold no match but are long, a start is only tried where a match can begin: after another character, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}{{1,64}}+ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{{1,63}}+){{1,8}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+.)(-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-])",
}
GAZETTEERS = {
    "email": r"(?i)\.(com|org|net|edu|gov|mil|int|info|biz|io|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at|be|br|in|jp)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6(011|4|5)|35|36|38|62)",
    "phone": r"^(\+(1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|[0-9(])",
}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(ip|ipv[46]|host|server|address|login|logged|client|adresse|direcci)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(phone|call|tel|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp)\b",
}
VOTES = ("strict", "gazetteer", "context", "border", "variety")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of at most 19 digits holds."""

    def add(total: Column, at: Column) -> Column:
        d = F.substring(digits, F.length(digits) - at, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(at % 2 == 1, twice).otherwise(d)

    fits = (F.length(digits) > 0) & (F.length(digits) <= 19)
    return F.when(fits, F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str, x: Column) -> Column:
    """The base rule's condition on a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    n = F.length(_digits(x))
    return ((n >= 16) & (n <= 19) & _luhn(_digits(x))) if kind == "card" else (n >= 8) & (n <= 15)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<x, s, before, after>>: each match, its start in code points, and text around it.

    Starts are sums of the lengths of what lies between matches and of the matches,
    taken over blocks of 64, so many matches in one text stay cheap.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.substring(p, -40, 40).alias("tail"), F.substring(p, 1, 20).alias("head"))).alias("g"))

    def spans(f: Column) -> Column:
        m, g = f["m"], f["g"]
        steps = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda a, b: F.length(a) + b["n"])

        def placed(s: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / 64).cast("int")), lambda k: F.aggregate(F.slice(s, k * 64 + 1, F.lit(64)), F.lit(0), lambda a, b: a + b))

            def with_blocks(b: Column) -> Column:
                before = F.transform(b, lambda _, k: F.aggregate(F.slice(b, F.lit(1), k), F.lit(0), lambda p, q: p + q))

                def start(base: Column) -> Column:
                    def one(x: Column, i: Column) -> Column:
                        k = F.floor(i / 64).cast("int")
                        at = F.get(base, k) + F.aggregate(F.slice(s, k * 64 + 1, i - k * 64), F.lit(0), lambda p, q: p + q) + F.get(g, i)["n"]
                        return F.struct(x.alias("x"), at.alias("s"), F.get(g, i)["tail"].alias("before"), F.get(g, i + 1)["head"].alias("after"))

                    return F.transform(m, one)

                return _let(before, start)

            return _let(blocks, with_blocks)

        return F.when(F.size(m) > 0, _let(steps, placed))

    return _let(found, spans)


_SPAN = "array<struct<kind:int,s:int,e:int,base:boolean,strict:int,gazetteer:int,context:int,border:int,variety:int,size:int>>"


def _candidates(kind: str, loose: bool, text: Column, guard: Column) -> Column:
    """The matches of one pattern, with each labeler's vote: 1 for, 0 against, -1 none."""
    number = KINDS.index(kind)

    def one(f: Column) -> Column:
        x, around = f["x"], F.concat_ws(" \n ", f["before"], f["after"])
        base = F.lit(False) if loose else _valid(kind, x)
        n = F.length(_digits(x))
        if loose:
            strict = F.lit(-1)
        elif kind == "card":  # shorter numbers with a right check sum are left to the others
            strict = F.when(base, 1).when((n >= 13) & (n <= 15) & _luhn(_digits(x)), -1).otherwise(0)
        else:
            strict = F.when(base, 1).otherwise(0)
        known = F.lit(-1) if loose and kind in ("phone", "ip") else F.when((_digits(x) if kind == "card" else x).rlike(GAZETTEERS[kind]), 1).otherwise(0)
        context = F.when(around.rlike(CONTEXT[kind]), 1).otherwise(0 if loose else -1)  # where no strict pattern speaks for it, no word nearby speaks against it
        border = F.when(f["before"].rlike(r"[\w@/\\=-]$") | f["after"].rlike(r"^[\w@/\\=]"), 0).otherwise(1)
        variety = F.when(F.size(F.array_distinct(F.split(F.substring(x, 1, 64), ""))) >= 5, 1).otherwise(0)
        size = F.when(F.length(x) < 12, 0).when(F.length(x) < 20, 1).when(F.length(x) < 32, 2).otherwise(3)
        return F.struct(F.lit(number).alias("kind"), f["s"].alias("s"), (f["s"] + F.length(x)).alias("e"), base.alias("base"), strict.alias("strict"), known.alias("gazetteer"), context.alias("context"), border.alias("border"), variety.alias("variety"), size.alias("size"))

    found = F.transform(_matches(text, LOOSE[kind] if loose else PATTERNS[kind]), one)
    if kind == "card":  # runs of few digits are no candidates
        found = F.filter(found, lambda c: (c["e"] - c["s"]) >= 13)
    return F.coalesce(F.when(guard, found), F.array()).cast(_SPAN)


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `pii`: all base spans and candidates of each text (null: empty)."""
    text = F.coalesce(docs["text"], F.lit(""))
    digit = text.rlike("[0-9]")
    obfuscated = text.contains("(at)") | text.contains("[at]") | text.contains("(AT)") | text.contains("[AT]")
    parts = [
        _candidates("email", False, text, text.contains("@")), _candidates("email", True, text, obfuscated),
        _candidates("ip", False, text, text.rlike(r"[0-9]\.[0-9]")), _candidates("ip", True, text, text.rlike(r"(?:[0-9A-Fa-f]{1,4}:){7}")),
        _candidates("card", False, text, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        _candidates("phone", False, text, text.contains("+") & digit), _candidates("phone", True, text, text.rlike("[0-9]{3}[ .-][0-9]{3}")),
    ]
    return docs.withColumn("pii", F.concat(*parts))


@dataclass
class SpanModel:
    """weights[kind]: the classifier's weights by feature name; reliability[kind][labeler]: (share of votes for, in each class)."""

    weights: dict[int, dict[str, float]]
    reliability: dict[int, dict[str, tuple[float, float]]]


_FEATURES = (*VOTES, "size")


def train(annotated: DataFrame, rounds: int = 40, prior: float = 0.5, right: float = 0.85, belief: float = 0.2) -> SpanModel:
    """Expectation-maximisation over vote patterns, then logistic regression on the posteriors.

    prior, the share of candidates that are personal data, is held fixed: where labelers
    seldom disagree the votes don't tell it, and an estimate of it runs off to 0 or 1.
    Labelers are believed to be right with probability `right` beforehand, as much as
    `belief` of the candidates would tell.
    """
    table = annotated.select(F.explode("pii").alias("c")).groupBy("c.kind", *[f"c.{f}" for f in _FEATURES]).agg(F.count("*").alias("n")).collect()  # at most 4 kinds x 3^5 votes x 4 sizes
    return fit([r.asDict() for r in table], rounds, prior, right, belief)


def fit(table: list[dict], rounds: int = 40, prior: float = 0.5, right: float = 0.85, belief: float = 0.2) -> SpanModel:
    """As train, of the table of vote patterns: kind, a value for each feature, and n."""
    weights, reliability = {}, {}
    for kind in sorted({r["kind"] for r in table}):
        rows = sorted((tuple(r[f] for f in _FEATURES), r["n"]) for r in table if r["kind"] == kind)
        votes, n = np.array([r[0][: len(VOTES)] for r in rows]), np.array([r[1] for r in rows], float)
        cast = votes >= 0
        held = belief * n.sum()
        yes, no = np.full(len(VOTES), right), np.full(len(VOTES), 1 - right)
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + np.where(cast, np.where(votes == 1, np.log(yes / no), np.log((1 - yes) / (1 - no))), 0).sum(axis=1)
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            w, v = (n * post)[:, None] * cast, (n * (1 - post))[:, None] * cast
            yes = ((w * (votes == 1)).sum(axis=0) + held * right) / (w.sum(axis=0) + held)
            no = ((v * (votes == 1)).sum(axis=0) + held * (1 - right)) / (v.sum(axis=0) + held)
            yes, no = np.clip(yes, 0.02, 0.98), np.clip(no, 0.02, 0.98)
        reliability[kind] = {v: (float(a), float(b)) for v, a, b in zip(VOTES, yes, no, strict=True)}
        names = sorted({f"{f}={v}" for r, _ in rows for f, v in zip(_FEATURES, r, strict=True)})
        x = np.array([[1.0] + [float(name in {f"{f}={v}" for f, v in zip(_FEATURES, r, strict=True)}) for name in names] for r, _ in rows])
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps, with a small penalty
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (n * (p - post)) + 0.1 * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        weights[kind] = {"": float(w[0])} | dict(zip(names, map(float, w[1:]), strict=True))
    return SpanModel(weights, reliability)


def decide(annotated: DataFrame, model: SpanModel, sure: float = 0.9) -> DataFrame:
    """annotated with `base` and `spans`: arrays of (kind, s, e), by kind and start.

    spans: the base's, and the candidates that the classifier gives `sure` or more, unless
    they overlap a base span.
    """
    weights = F.create_map(*[F.lit(x) for kind, own in model.weights.items() for name, w in own.items() for x in (f"{kind}:{name}", w)]) if model.weights else None

    def accepted(c: Column) -> Column:
        if weights is None:
            return F.lit(False)
        z = F.coalesce(weights[F.concat_ws(":", c["kind"].cast("string"), F.lit(""))], F.lit(-30.0))
        for f in _FEATURES:
            z = z + F.coalesce(weights[F.concat(c["kind"].cast("string"), F.lit(f":{f}="), c[f].cast("string"))], F.lit(0.0))
        return 1 / (1 + F.exp(-z)) >= sure

    plain = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))
    base = F.filter("pii", lambda c: c["base"])
    more = F.when(F.exists("pii", lambda c: ~c["base"]), F.filter("pii", lambda c: ~c["base"] & accepted(c)))
    out = annotated.withColumn("more", F.coalesce(F.transform(more, plain), F.array().cast("array<struct<kind:int,s:int,e:int>>"))).withColumn("base", F.transform(base, plain)).drop("pii")
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return out.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.array_distinct(F.concat("base", free)))).otherwise(F.col("base"))).drop("more")


def find(docs: DataFrame) -> DataFrame:
    """docs with `base` and `spans`; two passes over the texts, one to train, one to decide."""
    annotated = candidates(docs)
    return decide(annotated, train(annotated))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row; the counts are of base spans.

    Null texts are empty. Tables without candidates need no model: the spans are the base's, none.
    """
    found = find(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]))

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == number)).cast("long").alias(f"n_{KINDS[number]}")

    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    found = find(docs)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_start = F.array_sort(F.transform("spans", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))

    def add(held: Column, c: Column) -> Column:
        over = c["s"] < held["end"]
        piece = F.when(over, F.lit("")).otherwise(F.concat(F.substring(F.col("text"), held["end"] + 1, c["s"] - held["end"]), F.get(names, c["kind"])))
        return F.struct(F.greatest(held["end"], c["e"]).alias("end"), F.concat(held["out"], piece).alias("out"))

    whole = F.aggregate(by_start, F.struct(F.lit(0).alias("end"), F.lit("").alias("out")), add, lambda h: F.concat(h["out"], F.substring(F.col("text"), h["end"] + 1, F.length("text"))))
    found = found.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
    return found.select(*docs.columns)
