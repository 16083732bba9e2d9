"""Personal data by weak supervision, in SQL functions alone.

Four base kinds are found by pattern and check. Further candidates (secrets, local phone numbers, social security numbers,
bank accounts) come from a wider pattern; on each candidate four labelers vote for, against or abstain: the shape, a
gazetteer, the context before it, and a checksum or make-up test. Vote patterns are counted over the whole corpus, which
leaves at most a few hundred rows; expectation-maximisation over them estimates how reliable each labeler is, and a logistic
span classifier is fitted to the estimated truth. Its decision is a plain column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The base patterns. A match may only start where no earlier character of the same run could start one; the
# lookbehinds say so, which keeps long runs linear, and \G lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]
WIDE = "|".join([
    r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"(?<![A-Za-z])(?i:password|passwd|secret|token|api_key) ?[=:] ?\x22?[A-Za-z0-9_+/-]{8,}\x22?",
    r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
])
CUES = {
    "email": "mail|contact|write", "ip": "ip|server|host|address", "card": "card|visa|credit|pay", "phone": "call|phone|tel|fax|mobile|contact",
    "secret": "password|token|secret|key|login|credential", "ssn": "ssn|social|security", "iban": "iban|account|bank",
}
AGAINST = "version|section|isbn|figure|order|page"
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()
DOMAINS = "com org net edu gov io de fr es it nl eu uk".split()
LABELERS = ["shape", "gazetteer", "context", "check"]


def _spans(text: Column, pattern: str, has: Column, source: Column | None = None) -> Column:
    """array<struct<start, end, m>>, code points, end exclusive. source: text of the same length in which to look."""
    src = text if source is None else source
    found = F.regexp_extract_all(src, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(src, pattern, -1), lambda g: F.char_length(g))
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.coalesce(x["g"], F.lit(0))
        b = a + F.coalesce(F.char_length(x["m"]), F.lit(0))
        one = F.when(x["m"].isNotNull(), F.array(F.struct(a.alias("start"), b.alias("end"), x["m"].alias("m")))).otherwise(empty)
        return F.struct(b.alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.when(has, F.aggregate(F.arrays_zip(gaps.alias("g"), found.alias("m")), start, step, lambda acc: acc["out"])).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.char_length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def _found(docs: DataFrame) -> DataFrame:
    """docs with columns base (kind, start, end, m of all base matches, with `good` false where a check fails) and wide."""
    text = F.col("text")
    # all wide patterns but those of secrets need a digit
    some = text.rlike("[0-9]|AKIA|(?i:password|passwd|secret|token|api_key)")
    # separators that do not stand between digits can be no part of a card: a character of the same length takes their place
    chain = F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", "\u0001")
    look = {
        "email": _spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": _spans(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        "card": _spans(text, CARD, text.rlike("[0-9][ -]?" * 12 + "[0-9]"), chain),
        "phone": _spans(text, PHONE, F.contains(text, F.lit("+"))),
    }
    out = docs.select("id", "text", *[v.alias(k) for k, v in look.items()], _spans(text, WIDE, some).alias("wide"))
    kind_of = lambda k: lambda c: F.struct(F.lit(KINDS.index(k)).alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["m"].alias("m"), _valid(k, c["m"]).alias("good"))
    base = F.concat(*[F.transform(F.col(k), kind_of(k)) for k in look])
    return out.select("id", "text", base.alias("base"), "wide")


def _kind_of(m: Column) -> Column:
    return F.when(m.rlike("^(AKIA|(?i:password|passwd|secret|token|api_key))"), KINDS.index("secret")).when(m.rlike("^[A-Z]"), KINDS.index("iban")).when(m.rlike("^[0-9]{3}-[0-9]{2}-"), KINDS.index("ssn")).otherwise(KINDS.index("phone"))


def _before(start: Column) -> Column:
    return F.lower(F.substring(F.col("text"), F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))


def _candidates(found: DataFrame) -> DataFrame:
    """(id, base, cand): the base matches, and the wide matches that overlap no valid one of them, each as its kind, place, whether
    it passes its check (null for wide ones) and the votes on it. No text is kept."""
    free = F.filter("wide", lambda c: ~F.exists(F.filter("base", lambda b: b["good"]), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    full = lambda k, c, good: F.struct(k.alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["m"].alias("m"), good.alias("good"), _before(c["start"]).alias("before"))
    voted = lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["good"].alias("good"), *[v.cast("int").alias(n) for v, n in zip(votes(c), LABELERS)])
    wide = F.transform(free, lambda c: full(_kind_of(c["m"]), c, F.lit(None).cast("boolean")))
    base = F.transform("base", lambda b: full(b["k"], b, b["good"]))
    return found.select("id", F.transform(base, voted).alias("base"), F.transform(wide, voted).alias("cand"))


def _by_kind(k: Column, of: dict[str, Column], default: Column) -> Column:
    out = default
    for kind, value in of.items():
        out = F.when(k == KINDS.index(kind), value).otherwise(out)
    return out


def votes(c: Column) -> list[Column]:
    """Votes of LABELERS on a candidate (k, m, good, before): 1 for, -1 against, 0 no opinion."""
    k, m, good = c["k"], c["m"], c["good"]
    yes = lambda cond, no=0: F.when(cond, 1).otherwise(no)
    checked = F.when(good, 1).when(~good, -1)
    value = F.regexp_extract(m, "([A-Za-z0-9_+/-]+)\x22?$", 1)
    shape = F.coalesce(checked, _by_kind(k, {"secret": yes(F.char_length(value) >= 16), "phone": yes(m.startswith("(")), "ssn": yes(~m.rlike("^(000|666|9)"), -1), "iban": yes(F.char_length(m).between(15, 34), -1)}, F.lit(0)))
    gazetteer = _by_kind(k, {"email": yes(F.substring_index(F.lower(m), ".", -1).isin(DOMAINS)), "secret": yes(m.rlike("^(AKIA|(?i:password|token))")), "phone": F.when(good.isNotNull(), 0).otherwise(yes(_digits(m).rlike("^[2-9][0-8]"), -1)), "iban": yes(F.substring(m, 1, 2).isin(COUNTRIES), -1)}, F.lit(0))
    context = F.when(c["before"].rlike(f"(?:{AGAINST})\\W*$"), -1).otherwise(_by_kind(k, {x: yes(c["before"].rlike(f"\\b(?:{cue})")) for x, cue in CUES.items()}, F.lit(0)))
    check = F.coalesce(checked, _by_kind(k, {"secret": yes(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), -1), "phone": yes(F.char_length(_digits(m)) == 10, -1), "ssn": yes(~m.rlike("-00-|-0000$"), -1), "iban": yes(F.char_length(_digits(m)) * 2 >= F.char_length(m))}, F.lit(0)))
    return [shape, gazetteer, context, check]


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[dict], list[float]]:
    """EM over (kind, votes, count): the truth of each pattern and each labeler's chances of its votes given the truth."""
    truth = [1 / (1 + math.exp(-float(sum(v)))) for _, v, _ in patterns]
    rates: list[dict] = []
    for _ in range(rounds):
        n = [sum(c * (1 - t) for (_, _, c), t in zip(patterns, truth)) + 1, sum(c * t for (_, _, c), t in zip(patterns, truth)) + 1]
        rates = [{(x, y): (0.5 + sum(c * (t if y else 1 - t) for (_, v, c), t in zip(patterns, truth) if v[j] == x)) / (n[y] + 0.5) for x in (-1, 0, 1) for y in (0, 1)} for j in range(len(LABELERS))]
        odds = math.log(n[1] / n[0])
        truth = [1 / (1 + math.exp(-max(-30.0, min(30.0, odds + sum(math.log(rates[j][v[j], 1] / rates[j][v[j], 0]) for j in range(len(LABELERS))))))) for _, v, _ in patterns]
    return rates, truth


def _inputs(kind: int, v: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(x == 1) for x in v], *[float(x == -1) for x in v], *[float(kind == k) for k in range(4, len(KINDS))]]


def fit(patterns: list[tuple[int, tuple[int, ...], int]], truth: list[float], rounds: int = 400) -> list[float]:
    """A logistic classifier of spans, fitted to the estimated truth; patterns count by the logarithm of their number."""
    rows = [(_inputs(k, v), t, math.log1p(c)) for (k, v, c), t in zip(patterns, truth)]
    w = [0.0] * (1 + 2 * len(LABELERS) + len(KINDS) - 4)
    total = sum(c for _, _, c in rows) or 1.0
    for _ in range(rounds):
        grad = [1e-3 * x for x in w]
        for x, t, c in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for j, b in enumerate(x):
                grad[j] += (p - t) * b * c / total
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return w


def _score(c: Column, w: list[float]) -> Column:
    vs, out = [c[n] for n in LABELERS], F.lit(w[0])
    for j, v in enumerate(vs):
        out = out + F.when(v == 1, w[1 + j]).when(v == -1, w[1 + len(vs) + j]).otherwise(0.0)
    for k in range(4, len(KINDS)):
        out = out + F.when(c["k"] == k, w[1 + 2 * len(vs) + k - 4]).otherwise(0.0)
    return out


def patterns_of(cands: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    """Counts of (kind, votes) over all candidates and base matches: at most len(KINDS) * 3 ** len(LABELERS) rows."""
    both = cands.select(F.explode(F.concat("base", "cand")).alias("c"))
    rows = both.select("c.k", *[F.col(f"c.{n}") for n in LABELERS]).groupBy("k", *LABELERS).count().collect()
    return sorted((r["k"], tuple(r[n] for n in LABELERS), r["count"]) for r in rows)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_secret, n_ssn, n_iban.

    spans: `kind:start:end` of base and added spans by kind, then start, in code points, end exclusive, joined by commas; an
    added span overlaps no base span. n_spans counts all of them, n_secret, n_ssn and n_iban added ones; an added phone number is
    in n_spans only. A null text counts as empty and has no spans. Null and repeated ids pass through, each row for itself. Other
    columns are not read. Texts are gone through once; places and votes are stored for the count of votes and the decision.
    """
    found = common.stored(_candidates(_found(common.texts(docs, id_col, text_col))))
    counted = patterns_of(found)
    _, truth = estimate(counted)
    w = fit(counted, truth)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    place = lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"))
    good = F.transform(F.filter("base", lambda b: b["good"]), place)
    added = F.transform(F.filter("cand", lambda c: _score(c, w) >= 0), place)
    said = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")
    rows = found.select("id", good.alias("good"), added.alias("added"))
    count = lambda of, k: F.size(F.filter(of, lambda b: b["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(
        F.col("id").alias(id_col), *[count("good", k) for k in range(4)], F.sha2(said(F.col("good")), 256).alias("base_sha256"), said(F.concat("good", "added")).alias("spans"),
        (F.size("good") + F.size("added")).cast("long").alias("n_spans"), *[count("added", k) for k in range(4, len(KINDS))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"))


SQL = None
