"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans of eight kinds are found with regular expressions.  Four
labelers vote on each: its strict form (``regex``), lists of known domains, dial
codes, card prefixes and countries (``gazetteer``), cue words to its left
(``context``) and its borders (``shape``); a vote is 1, 0 (abstain) or -1.

``fit`` counts the candidates of all documents by kind, votes and features in
one aggregation.  The counts number at most kinds x 3**4 votes x 36 features, so
they are collected; expectation-maximisation over them estimates each labeler's
reliability per kind, and the posteriors weigh the counts of a naive Bayes span
classifier over votes and features.  ``detect`` applies it.

Spans of the base rules (email, ip, card, phone) always stand.  Other candidates
are added when the classifier finds them likelier than not and no base span
covers them.  Patterns start only where a run starts and repeat only single
characters, so very long runs of digits or name characters cost linear time.

Defined cases: a NULL or empty text has no spans; repeated rows get equal spans;
of spans with one start the order is by kind; an empty table gives an empty
model and no rows; other columns are kept untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table, staged, whole_text

KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn", "local_phone"]
BASE_KINDS = KINDS[:4]
LABELERS = ["regex", "gazetteer", "context", "shape"]
FEATURES = ["length", "digits", "before"]

CUES = {
    "email": r"mail|contact|write to|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|addr|ping|login from|adresse",
    "card": r"card|visa|master ?card|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|call|tel\b|mobile|fax|anruf|telefon|téléphone|llame",
    "secret": r"token|secret|passw|pwd|api[ _-]?key|access[ _-]?key|auth|bearer",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social security",
    "local_phone": r"phone|call|tel\b|mobile|fax|anruf|telefon|téléphone|llame",
}
AGAINST = r"version|isbn|issn|order|invoice|page|figure|serial|release|build|commit|sha1|md5"
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|it|eu|us|ch|at|nl|be)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)(?:sk_|pk_|ghp_|gho_|akia|xox|eyj|glpat)",
    "iban": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "local_phone": r"^\(?[2-9]",
}
CONTEXT_CHARS = 32
_DOT, _JOIN, _OTHER = "\x03", "\x01", "\x04"

FOUND = "array<struct<start:int,stop:int,hit:string>>"
CANDIDATE = "array<struct<start:int,kind_no:int,stop:int,kind:string,hit:string,base:boolean>>"


def _found(text: Column, pattern: str, least: int) -> Column:
    """Matches of at least ``least`` characters with their places, leftmost, not overlapping."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), stop.alias("stop"), pair["hit"].alias("hit"))
        out = F.when(F.length(pair["hit"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.when(pair["hit"].isNull(), acc).otherwise(F.struct(stop.alias("at"), out.alias("out")))

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def _candidates(found: Column, kind: str, keep, base) -> Column:
    no = KINDS.index(kind)
    return F.transform(F.filter(found, keep) if keep else found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(no).alias("kind_no"), x["stop"].alias("stop"),
        F.lit(kind).alias("kind"), x["hit"].alias("hit"), base(x["hit"]).alias("base")))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total, i):
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(F.pmod(n - i, F.lit(2)) == 0, digit).otherwise(
            F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _between(n: Column, least: int, most: int) -> Column:
    return (n >= least) & (n <= most)


_LOCAL = r"A-Za-z0-9._%+\x03-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+\x03[A-Za-z0-9\x03-]*"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
_CARD = r"[0-9][0-9\x01]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SECRET = r"(?<=[=:] ?[\"'])[A-Za-z0-9_+/.-]{16,}|(?<=[=:] ?)(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{16,}"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"


def _all_candidates(text: Column) -> Column:
    """Candidates of one text in order of start, then kind."""
    none = F.array().cast(CANDIDATE)
    plain = F.translate(text, _JOIN + _DOT, _OTHER * 2)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", _JOIN)
    has_mail = F.contains(text, F.lit("@"))
    has_number = F.rlike(text, F.lit("[0-9][0-9 ().-]{5,}[0-9]"))
    has_value = F.rlike(text, F.lit("[=:] ?[\"']?[A-Za-z0-9_+/.-]{16}"))
    has_iban = F.rlike(text, F.lit("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"))
    yes, no = (lambda hit: F.lit(True)), (lambda hit: F.lit(False))
    is_card = lambda hit: _between(F.length(_digits(hit)), 14, 19) & _luhn(_digits(hit))
    return F.array_sort(F.concat(
        F.when(has_mail, _candidates(_found(dotted, _EMAIL, 5), "email", None, yes)).otherwise(none),
        F.when(has_number, F.concat(
            _candidates(_found(plain, _IP, 7), "ip", None, lambda hit: F.rlike(hit, F.lit(_OCTETS))),
            _candidates(_found(joined, _CARD, 12), "card",
                        lambda x: _between(F.length(_digits(x["hit"])), 12, 19), is_card),
            _candidates(_found(plain, _PHONE, 4), "phone", None,
                        lambda hit: _between(F.length(_digits(hit)), 10, 15)),
            _candidates(_found(plain, _SSN, 11), "ssn", None, no),
            _candidates(_found(plain, _LOCAL_PHONE, 12), "local_phone", None, no))).otherwise(none),
        F.when(has_value, _candidates(_found(plain, _SECRET, 16), "secret", None, no)).otherwise(none),
        F.when(has_iban, _candidates(_found(plain, _IBAN, 15), "iban", None, no)).otherwise(none)))


def _vote(yes: Column, against: Column) -> Column:
    return F.when(against, -1).when(yes, 1).otherwise(0)


def _by_kind(kind: Column, make) -> Column:
    out = F.lit(None)
    for name in reversed(KINDS):
        out = F.when(kind == name, make(name)).otherwise(out)
    return out


def _judged(text: Column, c: Column) -> Column:
    """A candidate with its four votes and three features."""
    hit, kind = c["hit"], c["kind"]
    first = F.greatest(c["start"] - CONTEXT_CHARS, F.lit(0))
    left = F.lower(F.substring(text, first + 1, c["start"] - first))
    before = F.when(c["start"] == 0, "").otherwise(F.substring(text, c["start"], F.lit(1)))
    after = F.substring(text, c["stop"] + 1, F.lit(1))
    digits = _digits(hit)
    strict = _by_kind(kind, lambda k: {
        "secret": F.rlike(hit, F.lit("[0-9]")) & F.rlike(hit, F.lit("[A-Za-z]")),
        "iban": _between(F.length(hit), 15, 34), "ssn": F.lit(True),
        "local_phone": F.length(digits) == 10}.get(k, c["base"]))
    known = _by_kind(kind, lambda k: F.rlike(F.replace(hit, F.lit(_DOT), F.lit(".")), F.lit(GAZETTEER[k])))
    cue = _by_kind(kind, lambda k: F.rlike(left, F.lit(CUES[k])))
    against = F.rlike(left, F.lit(AGAINST))
    tight = F.rlike(before, F.lit("[A-Za-z0-9]")) | F.rlike(after, F.lit("[A-Za-z0-9]"))
    doubtful = kind.isin("card", "iban", "ssn", "ip")
    share = F.length(digits) / F.length(hit)
    return F.struct(
        _vote(strict, ~strict).alias("regex"),
        _vote(known, ~known & doubtful).alias("gazetteer"),
        _vote(cue, against & ~cue).alias("context"),
        _vote(~tight, tight).alias("shape"),
        F.when(F.length(hit) < 12, 0).when(F.length(hit) < 18, 1).when(F.length(hit) < 30, 2)
         .otherwise(3).alias("length"),
        F.when(share < 0.3, 0).when(share < 0.8, 1).otherwise(2).alias("digits"),
        F.when(F.trim(before) == "", 0).when(F.rlike(before, F.lit("[A-Za-z0-9]")), 2)
         .otherwise(1).alias("before"))


def _with_candidates(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """``docs`` with candidates and their judgements: struct ``into`` (text, found)."""
    text = whole_text(text_col)
    rows = docs.withColumn(into, F.struct(text.alias("text"), _all_candidates(text).alias("found")))
    return rows.withColumn(into, F.struct(
        F.col(f"{into}.text").alias("text"),
        F.transform(F.col(f"{into}.found"), lambda c: F.struct(
            c.alias("span"), _judged(F.col(f"{into}.text"), c).alias("seen"))).alias("found")))


# ---- the model, on collected counts ----------------------------------------

def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _normal(weights: dict, values, smooth: float = 1.0) -> dict:
    total = sum(weights.get(v, 0.0) + smooth for v in values)
    return {v: (weights.get(v, 0.0) + smooth) / total for v in values}


def expectation_maximisation(counts: list[tuple[tuple, float]], rounds: int = 50):
    """Posterior by vote pattern, and each labeler's vote rates per class.

    Starts from the majority of votes; votes of the labelers are independent given
    the class.
    """
    post = {votes: _sigmoid(1.5 * sum(votes)) for votes, _ in counts}
    rates, prior = [], 0.5
    for _ in range(rounds):
        total = sum(n for _, n in counts)
        prior = (sum(n * post[v] for v, n in counts) + 1) / (total + 2)
        rates = []
        for k in range(len(LABELERS)):
            own = [{}, {}]
            for votes, n in counts:
                own[1][votes[k]] = own[1].get(votes[k], 0.0) + n * post[votes]
                own[0][votes[k]] = own[0].get(votes[k], 0.0) + n * (1 - post[votes])
            rates.append([_normal(own[z], (-1, 0, 1)) for z in (0, 1)])
        new = {v: _sigmoid(math.log(prior / (1 - prior)) + sum(
            math.log(rates[k][1][x] / rates[k][0][x]) for k, x in enumerate(v))) for v in post}
        done = max((abs(new[v] - post[v]) for v in new), default=0) < 1e-9
        post = new
        if done:
            break
    return post, prior, rates


def train(rows: list[tuple]) -> dict[str, float]:
    """Log-odds by ``kind|name|value`` from rows (kind, votes..., features..., n)."""
    model: dict[str, float] = {}
    for kind in KINDS:
        own = [(tuple(r[1:5]), tuple(r[5:8]), float(r[8])) for r in rows if r[0] == kind]
        if not own:
            continue
        by_votes: dict[tuple, float] = {}
        for votes, _, n in own:
            by_votes[votes] = by_votes.get(votes, 0.0) + n
        post, prior, rates = expectation_maximisation(sorted(by_votes.items()))
        model[f"{kind}|prior|0"] = math.log(prior / (1 - prior))
        for k, name in enumerate(LABELERS):
            for vote in (-1, 0, 1):
                model[f"{kind}|{name}|{vote}"] = math.log(rates[k][1][vote] / rates[k][0][vote])
        for k, name in enumerate(FEATURES):
            weights = [{}, {}]
            for votes, features, n in own:
                value = features[k]
                weights[1][value] = weights[1].get(value, 0.0) + n * post[votes]
                weights[0][value] = weights[0].get(value, 0.0) + n * (1 - post[votes])
            ratio = [_normal(w, range(4)) for w in weights]
            for value in range(4):
                model[f"{kind}|{name}|{value}"] = math.log(ratio[1][value] / ratio[0][value])
    return model


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The span classifier, from counts over all candidates of ``docs``."""
    name = fresh(docs, "pii")
    rows = _with_candidates(docs.select(F.col(text_col)), text_col, name)
    return _fit_found(rows.select(F.col(f"{name}.found").alias("found")))


def _fit_found(rows: DataFrame) -> dict[str, float]:
    """The same, from the candidates in ``found``."""
    seen = rows.select(F.explode("found").alias("c")).select(F.col("c.span.kind").alias("kind"), "c.seen.*")
    counts = seen.groupBy("kind", *LABELERS, *FEATURES).count().collect()
    return train(sorted(tuple(r) for r in counts))


# ---- applying it -----------------------------------------------------------

def detect(docs: DataFrame, model: dict[str, float], into: str = "spans", text_col: str = "text") -> DataFrame:
    """``docs`` with the array ``into`` of (start, kind_no, stop, kind, base), in order."""
    rows = _with_candidates(docs, text_col, into)
    return _chosen(rows.withColumn(into, F.col(f"{into}.found")), model, into)


def _chosen(rows: DataFrame, model: dict[str, float], into: str) -> DataFrame:
    """``rows`` with the spans that stand among the candidates in ``into``."""
    odds = F.create_map(*[F.lit(x) for pair in sorted(model.items()) for x in pair]) if model else None

    def weight(c, name, value):
        key = F.concat_ws("|", c["span"]["kind"], F.lit(name), value.cast("string"))
        return F.coalesce(F.element_at(odds, key), F.lit(0.0))

    def likely(c):
        if odds is None:
            return F.lit(False)
        total = weight(c, "prior", F.lit(0))
        for name in (*LABELERS, *FEATURES):
            total = total + weight(c, name, c["seen"][name])
        return total > 0

    found = F.col(into)
    base = F.filter(found, lambda c: c["span"]["base"])
    strip = lambda c: F.struct(*[c["span"][x].alias(x) for x in ("start", "kind_no", "stop", "kind", "base")])
    rows = rows.withColumn(into, F.struct(
        F.transform(base, strip).alias("base"),
        F.transform(F.filter(found, lambda c: ~c["span"]["base"] & likely(c)), strip).alias("more")))
    covered = lambda c: F.exists(F.col(f"{into}.base"), lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    return rows.withColumn(into, F.array_sort(F.concat(
        F.col(f"{into}.base"), F.filter(F.col(f"{into}.more"), lambda c: ~covered(c)))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans
    become one.  A NULL text stays NULL.  Candidates are looked for once and written with
    their rows; the classifier is fitted and applied to what was written."""
    name = fresh(docs, "spans")
    rows = _with_candidates(docs, text_col, name)
    rows = staged(rows.withColumn(name, F.col(f"{name}.found")), "pii-candidates")
    rows = _chosen(rows, _fit_found(rows.select(F.col(name).alias("found"))), name)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, span):
        gap = F.substring(text, acc["at"] + 1, span["start"] - acc["at"])
        tag = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.when(span["start"] >= acc["at"], F.struct(
            span["stop"].alias("at"), F.concat(acc["out"], F.array(gap, tag)).alias("out"))) \
            .otherwise(F.struct(F.greatest(acc["at"], span["stop"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate(F.col(name), start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size(name) == 0, text).otherwise(clean)).drop(name)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = detect(docs, fit(docs)).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind)))
    return rows.select(
        "doc_id", *[number(kind).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
