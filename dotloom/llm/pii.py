"""Personal data by weak supervision, in DataFrame functions alone.

Base spans (email, ip, card, phone) are regular expressions with checks. Further candidates are tokens of eight
characters or more that hold a digit or stand behind an assignment. Labelers vote on them: known formats (regex), words
for credentials ahead (gazetteer), an assignment ahead and quotes on both sides (context), letters and digits in turn,
and the absence of a run of letters that reads like a word. Expectation maximisation over the counts of vote patterns
(at most 2 ** 6 rows, whatever the corpus) estimates each labeler's reliability and each pattern's posterior. A logistic
span classifier over the votes, pairs of votes and features that no labeler sees (length, digits, cases) is trained on
the posteriors over counts of (votes, features), at most 2 ** 11 rows, and compiled into a column expression. Accepted
spans are added as kind ``secret``; base spans stay.

The regular expressions are possessive and begin where a run of their characters begins, so that a long run costs
linear time and no deep recursion; they find what the plain forms find.

Defined results: null and empty texts have no spans; repeated rows give a row each; without candidates nothing is
added; empty tables give empty ones; further columns of any name are kept by ``redact`` and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import with_only

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with a digit, or behind a colon or an equals sign.
TOKEN = r"(?:\G|(?<![A-Za-z0-9_-]))(?:(?=[A-Za-z_-]*+[0-9])|(?<=[:=]\s{0,2}[\"']?))[A-Za-z0-9][A-Za-z0-9_-]{7,}+"
SMALL = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
FORMAT = (
    r"^(?:[0-9a-f]{32,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|(?:AKIA|ASIA)[0-9A-Z]{12,}|AIza[0-9A-Za-z_-]{30,}|eyJ[0-9A-Za-z_-]{10,}|(?:sk|pk|rk|ghp|gho|xox[a-z])[-_][A-Za-z0-9_-]{12,})$"
)
#: Words for credentials and numbers of persons, in English, German, French and Spanish.
GAZETTEER = [
    "token", "secret", "password", "passwd", "pwd", "passphrase", "pin", "api[ _-]?key", "access[ _-]?key", "key", "ssn", "iban", "passport", "account", "credential", "login", "bearer", "auth",
    "passwort", "kennwort", "schl(?:ü|ue)ssel", "konto", "ausweis", "mot de passe", "clé", "jeton", "compte", "contraseña", "clave", "cuenta", "pasaporte",
]
KEYS = r"(?i)(?<![a-z0-9])(?:" + "|".join(GAZETTEER) + r")s?(?![a-z0-9])"
KINDS = ["email", "ip", "card", "phone"]
CONTEXT = 24


def _blocks(items: Column) -> Column:
    """An array in slices of about the root of its size (64 at least), so that a fold over each and one over the slices stay far from quadratic; none for an empty one."""
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int"))
    cut = bound(size, lambda b: F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / b).cast("int")), lambda i: F.slice(items, i * b + 1, b)))
    return F.when(F.size(items) > 0, cut)


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans(text: Column, pattern: str, hint: Column) -> Column:
    """Matches as array<struct<s, e, m, before, after>>, code points; ``before`` and ``after`` are the text next to it, earlier matches included. Only where ``hint`` holds."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    z = F.arrays_zip(m.alias("m"), F.slice(pieces, F.lit(1), F.size(m)).alias("q"), F.slice(pieces, F.lit(2), F.size(m)).alias("n"))
    kind = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
    none = F.expr(f"CAST(array() AS {kind})")

    def tail(x):
        return F.substring(x, -CONTEXT, CONTEXT)

    def step(acc, z):
        s = acc["at"] + F.length(z["q"])
        e = s + F.length(z["m"])
        before = tail(F.concat(acc["tail"], tail(z["q"])))
        out = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), z["m"].alias("m"), before.alias("before"), F.substring(z["n"], 1, 4).alias("after"))))
        return F.struct(e.alias("at"), tail(F.concat(before, tail(z["m"]))).alias("tail"), out.alias("out"))

    def block(acc, part):
        got = F.aggregate(part, F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), none.alias("out")), step)
        return bound(got, lambda r: F.struct(r["at"].alias("at"), r["tail"].alias("tail"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.expr(f"CAST(array() AS array<{kind}>)").alias("outs"))
    found = bound(z, lambda z: F.aggregate(_blocks(z), start, block, lambda a: F.flatten(a["outs"])))
    return F.when(hint, F.coalesce(found, none)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    r = F.reverse(digits)

    def add(acc, i):
        d = F.substring(r, i, F.lit(1)).cast("int")
        two = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, two).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _card(x) -> Column:
    d = _digits(x["m"])
    return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of spans for each base kind."""
    t = F.coalesce("text", F.lit(""))
    d = docs.withColumn("text", t).withColumn("digit", F.col("text").rlike("[0-9]"))
    text = F.col("text")
    d = d.withColumns({
        "email": spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(spans(text, IP, F.col("digit") & text.contains(".")), lambda x: x["m"].rlike(rf"^{SMALL}\.{SMALL}\.{SMALL}\.{SMALL}$")),
        "card": F.filter(spans(text, CARD, text.rlike("[0-9](?:[ -]?[0-9]){12}")), _card),
        "phone": F.filter(spans(text, PHONE, text.contains("+")), lambda x: F.length(_digits(x["m"])).between(9, 15)),
    })
    return d.drop("digit")


# ---------------------------------------------------------------- weak supervision
VOTES = ["format", "keyword", "assigned", "quoted", "mixed", "opaque"]
FEATURES = ["long", "very_long", "digits", "upper", "lower"]


def _votes(x) -> Column:
    m, before, after = x["m"], x["before"], x["after"]
    votes = [
        m.rlike(FORMAT), before.rlike(KEYS), before.rlike(r"[:=]\s*[\"']?$"), before.rlike(r"[\"']$") & after.rlike(r"^[\"']"),
        m.rlike(r"[0-9][A-Za-z]+[0-9]+[A-Za-z]|[A-Za-z][0-9]+[A-Za-z]+[0-9]"), ~m.rlike("[A-Za-z][a-z]{3}"),
    ]
    features = [F.length(m) >= 16, F.length(m) >= 32, F.length(_digits(m)) >= 4, m.rlike("[A-Z]"), m.rlike("[a-z]")]
    return F.struct(*[c.cast("int").alias(k) for k, c in zip([*VOTES, *FEATURES], [*votes, *features], strict=True)])


def with_candidates(base: DataFrame) -> DataFrame:
    """``base`` with the candidates outside the base spans, and their votes and features."""
    taken = F.concat(*[F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS])
    text = F.col("text")
    # The hint: every candidate has a digit, or an assignment ahead.
    d = base.withColumn("tokens", spans(text, TOKEN, text.rlike("[0-9:=]"))).withColumn("taken", taken)
    over = lambda s, e, t: (t["s"] < e) & (s < t["e"])
    # A block of tokens meets the base spans within its own stretch alone.
    near = lambda part: F.filter("taken", lambda t: over(part[0]["s"], F.element_at(part, -1)["e"], t))
    apart = lambda part: bound(near(part), lambda taken: F.filter(part, lambda x: ~F.exists(taken, lambda t: over(x["s"], x["e"], t))))
    free = F.when(F.size("taken") == 0, F.col("tokens")).otherwise(F.coalesce(F.flatten(F.transform(_blocks(F.col("tokens")), apart)), F.col("tokens")))
    return d.withColumn("cand", F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _votes(x).alias("v")))).drop("tokens", "taken")


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, list[float], list[float], dict[tuple[int, ...], float]]:
    """EM over vote patterns: prior, each labeler's hit and false-alarm rates, and each pattern's posterior."""
    n, k = sum(counts.values()), len(next(iter(counts)))
    prior, hit, alarm = 0.3, [0.7] * k, [0.15] * k
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v in counts:
            a, b = math.log(prior), math.log(1 - prior)
            for x, h, f in zip(v, hit, alarm, strict=True):
                a += math.log(h if x else 1 - h)
                b += math.log(f if x else 1 - f)
            post[v] = 1 / (1 + math.exp(min(50.0, max(-50.0, b - a))))
        one = sum(c * post[v] for v, c in counts.items())
        prior = min(0.99, max(0.01, one / n))
        hit = [(sum(c * post[v] * v[j] for v, c in counts.items()) + 0.7) / (one + 1) for j in range(k)]
        alarm = [(sum(c * (1 - post[v]) * v[j] for v, c in counts.items()) + 0.15) / (n - one + 1) for j in range(k)]
        hit, alarm = ([min(0.999, max(0.001, x)) for x in r] for r in (hit, alarm))
    return prior, hit, alarm, post


def _features(v, extra) -> list:
    return [*v, *[v[i] * v[j] for i in range(len(v)) for j in range(i)], *extra]


def train(counts: dict[tuple[int, ...], int], post: dict[tuple[int, ...], float], rounds: int = 2000) -> tuple[float, list[float]]:
    """Logistic weights over votes, their pairs and the features, fitted to the posteriors of the votes (gradient steps over the patterns)."""
    k, n = len(next(iter(post))), sum(counts.values())
    rows = [(_features(p[:k], p[k:]), post[p[:k]], c / n) for p, c in counts.items()]
    w, b = [0.0] * len(rows[0][0]), 0.0
    for _ in range(rounds):
        gw, gb = [0.001 * x for x in w], 0.0
        for x, y, share in rows:
            g = share * (1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(p * q for p, q in zip(w, x, strict=True)))))) - y)
            gb += g
            gw = [p + g * q for p, q in zip(gw, x, strict=True)]
        w, b = [p - 0.7 * q for p, q in zip(w, gw, strict=True)], b - 0.7 * gb
    return b, w


def classifier(cand: DataFrame) -> tuple[float, list[float]] | None:
    """The span classifier's weights, from the candidates of all texts; None without any."""
    names = [*VOTES, *FEATURES]
    # The outer form: for the inner one Spark puts a filter below, which searches all texts a second time.
    rows = cand.select(F.explode_outer("cand.v").alias("v")).where("v IS NOT NULL").groupBy(*[F.col(f"v.{k}").alias(k) for k in names]).agg(F.count("*").alias("n")).collect()
    counts = dict(sorted((tuple(r[k] for k in names), r.n) for r in rows))
    if not counts:
        return None
    votes: dict[tuple[int, ...], int] = {}
    for p, n in counts.items():
        votes[p[: len(VOTES)]] = votes.get(p[: len(VOTES)], 0) + n
    return train(counts, reliabilities(votes)[3], 400)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, others) with arrays email, ip, card, phone and secret of struct<s, e, ...>."""
    cand = with_candidates(with_base(docs))
    # The fit needs the candidates alone.
    model = classifier(with_candidates(with_base(with_only(docs, "text"))))
    if model is None:
        return cand.withColumnRenamed("cand", "secret")
    b, w = model

    def accepted(x):
        total = F.lit(b)
        for weight, f in zip(w, _features([x["v"][k] for k in VOTES], [x["v"][k] for k in FEATURES]), strict=True):
            total = total + f * weight
        return total >= 0

    return cand.withColumn("secret", F.filter("cand", accepted)).drop("cand")


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def _listed(kinds) -> Column:
    return F.concat_ws(",", F.concat(*map(_named, kinds)))


def _marked(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("k")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns kept) with every span of ``text`` replaced by its kind in brackets; null stays null."""
    keep = docs.columns
    # The values are carried in a struct, so that further columns of any name don't clash.
    found = find(docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["text"].alias("text")))
    every = F.concat(*map(_marked, (*KINDS, "secret")))

    def block(acc, part):
        """The text from the last block's end to this one's, cut out once, and its pieces within that."""
        end = F.greatest(acc["at"], F.array_max(F.transform(part, lambda x: x["e"])))

        def step(chunk):
            def one(a, x):
                at = F.greatest(x["s"], a["at"])
                new = F.concat(a["out"], F.array(F.substring(chunk, a["at"] - acc["at"] + 1, at - a["at"]), x["k"]))
                return F.when(x["e"] <= a["at"], a).otherwise(F.struct(x["e"].alias("at"), new.alias("out")))

            return F.aggregate(part, F.struct(acc["at"].alias("at"), F.expr("CAST(array() AS array<string>)").alias("out")), one)

        got = bound(F.substring(F.col("text"), acc["at"] + 1, end - acc["at"]), step)
        return bound(got, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    done = bound(F.array_sort(every), lambda x: F.aggregate(_blocks(x), start, block, rest))
    text = F.when(F.col("row.text").isNotNull(), F.when(F.size(every) == 0, F.col("text")).otherwise(done))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text of ``documents``."""
    found = find(with_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed([*KINDS, "secret"]).alias("spans"),
    )
