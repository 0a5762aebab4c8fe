"""Personal data by weak supervision: fixed patterns, and candidates on which labelers vote; DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, rewritten so that the engine never backtracks over a run of characters.
# A local part, a number or a card can only begin where a run begins, or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Candidate patterns of kinds that the method adds.
ADDED = {
    "hidden_email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?[(\[]at[)\]]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[(\[]dot[)\]])\s?[A-Za-z0-9-]{1,63}){1,8}+",
    "local_phone": r"(?<![0-9+().\x20-])(?:\([0-9]{2,5}\)[\x20-]?[0-9]{2,4}|[0-9]{3})[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?+(?![0-9-])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
KINDS = [*BASE, *ADDED]
#: What every match of an added kind contains; most texts have none of it.
_HINT = r"(?i)[(\[]at[)\]]|[0-9][).\x20-]{1,2}[0-9]{2}|[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"

# The gazetteer and the context words of the labelers.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "eu"]
IBAN_COUNTRIES = ["AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
GIVEN_NAMES = [
    "alice", "anna", "antonio", "bob", "carlos", "carmen", "charles", "claire", "david", "elena", "emma", "eva", "francois", "hans", "isabel", "jacques", "james", "jane",
    "jean", "joe", "john", "jose", "juan", "julia", "karl", "laura", "linda", "louis", "lucia", "luis", "maria", "marie", "mark", "mary", "michael", "miguel", "olga", "paul",
    "pedro", "peter", "pierre", "robert", "sarah", "sofia", "stefan", "susan", "thomas", "ursula", "william", "wolfgang",
]
FOR_CONTEXT = r"(?i)\b(?:tel|phone|call|mobile|cell|fax|mail|contact|reach|write|ssn|social|iban|account|konto|telefon|correo)\b"
AGAINST_CONTEXT = r"(?i)\b(?:isbn|version|order|item|page|pages|sha|id|ref|no|nr|section|chapter)\b"
_NAMED = r"(?i)\b(?:" + "|".join(GIVEN_NAMES) + r")\b"
CONTEXT = 40
#: Matches that are placed together.
RUN = 64
_NO_SPANS = "cast(array() AS array<struct<s:int,e:int,k:int,m:string>>)"
LABELERS = ["pattern", "gazetteer", "context", "against", "structure"]


def luhn(card: Column) -> Column:
    """Whether the digits of a card number pass the Luhn test."""
    digits = F.reverse(F.regexp_replace(card, "[^0-9]", ""))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substring(digits, i, 1).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, 1).cast("int") + 1)),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return luhn(m) if kind == "card" else F.lit(True)


def _checks(kind: str):
    return lambda x: _valid(kind, x["m"])


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (s, e, kind, m) of the pattern's matches, in code points: gaps and matches alternate, so their running lengths are the
    positions. Matches are taken in runs of RUN, whose starts are summed first, as an array that grows by one is copied each time."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(F.transform(gaps, lambda x: F.length(x)).alias("g"), found.alias("m")), lambda x: x["m"].isNotNull())
    run_of = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: F.slice(all_, i * RUN + 1, RUN))
    walked = _let(_let(pairs, run_of), lambda runs: F.flatten(F.zip_with(runs, _starts(runs), lambda run, at: _placed(run, at, KINDS.index(kind)))))
    return F.when(text.rlike(pattern), walked).otherwise(F.expr(_NO_SPANS))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _wide(x: Column) -> Column:
    return x["g"] + F.length(x["m"])


def _starts(runs: Column) -> Column:
    """Where each run of matches starts: the lengths of all runs before it."""
    lengths = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda p, x: p + _wide(x)))
    return F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n), lambda out: F.slice(out, 1, F.size(out) - 1))


def _placed(run: Column, at: Column, kind_no: int) -> Column:
    start = F.struct(at.alias("p"), F.expr(_NO_SPANS).alias("o"))
    span = lambda p, x: F.struct((p + x["g"]).alias("s"), (p + _wide(x)).alias("e"), F.lit(kind_no).alias("k"), x["m"].alias("m"))
    return F.aggregate(run, start, lambda a, x: F.struct((a["p"] + _wide(x)).alias("p"), F.array_append(a["o"], span(a["p"], x)).alias("o")), lambda a: a["o"])


def candidates(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs' key with base (valid spans of the fixed patterns) and more (candidates of the added kinds that touch no base span)."""
    t = F.coalesce(F.col("_t"), F.lit(""))
    arrays = [F.filter(_matches(t, k, p), _checks(k)) for k, p in BASE.items()]
    none = F.expr(_NO_SPANS)
    digits = F.when(t.rlike("[0-9@]"), F.concat(*arrays)).otherwise(none)
    more = F.when(t.rlike(_HINT), F.concat(*(_matches(t, k, p) for k, p in ADDED.items()))).otherwise(none)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).withColumn("base", digits).withColumn("_more", more)
    free = F.filter("_more", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return rows.withColumn("more", free)


def _votes(x: Column, t: Column) -> Column:
    """One digit for each labeler: 0 against, 1 abstains, 2 for."""
    before = F.substring(t, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    m = x["m"]
    name = F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    pattern = F.when(name == "hidden_email", F.when(m.rlike(r"(?i)[(\[]at[)\]].*[(\[.]"), 2).otherwise(1)).when(name == "local_phone", F.when(digits.between(9, 12), 2).otherwise(0)).otherwise(2)
    domain = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    gazetteer = F.when(name == "hidden_email", F.when(domain.isin(TOP_DOMAINS), 2).otherwise(0)).when(name == "iban", F.when(F.substring(m, 1, 2).isin(IBAN_COUNTRIES), 2).otherwise(0)).when(before.rlike(_NAMED), 2).otherwise(1)
    context = F.when(before.rlike(FOR_CONTEXT), 2).otherwise(1)
    against = F.when(before.rlike(AGAINST_CONTEXT), 0).otherwise(1)
    structure = (
        F.when(name == "id_number", F.when(m.rlike("^(?:000|666|9)|-00-|-0000$"), 0).otherwise(2))
        .when(name == "local_phone", F.when(m.rlike(r"^\("), 2).when(digits < 9, 0).otherwise(1))
        .when(name == "iban", F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), 2).otherwise(0))
        .otherwise(1)
    )
    return F.concat(*(v.cast("string") for v in (pattern, gazetteer, context, against, structure)))


def _shape(x: Column) -> Column:
    return F.least(F.length(x["m"]) / 8, F.lit(4)).cast("int")


class SpanModel:
    """Reliabilities of the labelers by expectation-maximisation, and the final span classifier fitted to its posteriors."""

    def __init__(self, rows: list[tuple[int, str, int, int]], rounds: int = 50):
        """rows: (kind, votes, shape, count), one for each distinct pattern over all documents."""
        self.weights: dict[tuple, float] = {}
        self.bias = 0.0
        self.reliability = {}
        if not rows:
            return
        votes = np.array([[int(c) for c in v] for _, v, _, _ in rows])
        n = np.array([r[3] for r in rows], float)
        post = 1 / (1 + np.exp(-(votes - 1).sum(axis=1) * 1.5))  # start at the majority
        for _ in range(rounds):
            prior = np.clip((n * post).sum() / n.sum(), 0.05, 0.95)
            up, down = np.log(prior) * np.ones(len(n)), np.log(1 - prior) * np.ones(len(n))
            for j in range(len(LABELERS)):
                cast = votes[:, j] != 1
                right = (n * np.where(votes[:, j] == 2, post, 1 - post))[cast].sum()
                acc = np.clip((right + 4) / (n[cast].sum() + 5), 0.55, 0.99)
                self.reliability[LABELERS[j]] = float(acc)
                up += np.where(cast, np.log(np.where(votes[:, j] == 2, acc, 1 - acc)), 0)
                down += np.where(cast, np.log(np.where(votes[:, j] == 2, 1 - acc, acc)), 0)
            post = 1 / (1 + np.exp(np.clip(down - up, -30, 30)))
        features = [[("kind", k), ("shape", k, s), *((LABELERS[j], int(c)) for j, c in enumerate(v) if c != "1")] for k, v, s, _ in rows]
        names = sorted({f for x in features for f in x}, key=str)
        x = np.array([[f in y for f in names] for y in features], float)
        w, b = np.zeros(len(names)), 0.0
        for _ in range(500):
            err = n / n.sum() * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - post)
            w, b = w - 2.0 * (x.T @ err + 1e-3 * w), b - 2.0 * err.sum()
        self.weights, self.bias = dict(zip(names, w.tolist(), strict=True)), float(b)

    def accept(self, kind: int, votes: str, shape: int) -> bool:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in [("kind", kind), ("shape", kind, shape), *((LABELERS[j], int(c)) for j, c in enumerate(votes) if c != "1")])
        return z >= 0


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans of personal data: key, base and spans, arrays of (s, e, k) in code points with k an index of KINDS, by s and k.

    base holds the fixed patterns' valid matches. Candidates of further kinds get votes of five labelers (pattern, gazetteer,
    context for, context against, structure). Counts of distinct vote patterns over all documents, a few hundred
    at most, come to the driver; expectation-maximisation gives the labelers' reliabilities and posteriors, a logistic
    classifier is fitted to these, and accepted candidates join the base spans. Null counts as empty; repeated rows get
    equal spans; without any candidate the model accepts nothing; an empty table gives an empty result; null keys are keys; further columns, whatever their
    names, are dropped. A very long text is one row of its task; its matches are placed in runs, and candidates are compared with each base span of
    their text. No shuffle but that of the counts.
    """
    found = candidates(docs, text, key)
    voted = found.withColumn("voted", F.transform("more", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), _votes(x, F.coalesce(F.col("_t"), F.lit(""))).alias("v"), _shape(x).alias("h"))))
    hinted = docs.select(F.col(key).alias(key), F.col(text).alias(text)).where(F.coalesce(F.col(text), F.lit("")).rlike(_HINT))
    counted = candidates(hinted, text, key).select("_t", F.explode("more").alias("x")).select(F.col("x.k").alias("k"), _votes(F.col("x"), F.coalesce(F.col("_t"), F.lit(""))).alias("v"), _shape(F.col("x")).alias("h"))
    patterns = sorted((r["k"], r["v"], r["h"], r["n"]) for r in counted.groupBy("k", "v", "h").agg(F.count("*").alias("n")).collect())
    model = SpanModel(patterns)
    good = [f"{k}:{v}:{h}" for k, v, h, _ in patterns if model.accept(k, v, h)]
    kept = F.filter("voted", lambda x: F.concat_ws(":", x["k"], x["v"], x["h"]).isin(good)) if good else F.filter("voted", lambda x: F.lit(False))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return voted.select(F.col("_k").alias(key), F.array_sort(slim("base")).alias("base"), F.array_sort(F.concat(slim("base"), slim(kept))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")
