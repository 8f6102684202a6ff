"""Personal data by weak supervision, with DataFrame and SQL functions only.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates come
from wider patterns (bracketed addresses, local phone numbers, account numbers, secrets).
Labelers vote on every candidate: its pattern, a gazetteer (top-level domains, reserved
networks, card prefixes, country codes), words in its context, its borders, its shape.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for
each kind; the expected labels then train the final span classifier, log-odds of votes and span
features. A candidate outside the base set is a span when its odds are positive.

Texts are read once; what follows works on candidate rows and then on counts of (kind, votes,
features), whose number is bounded by the labelers, not by the documents.

The patterns are written for linear time: a run of letters is entered at its start only,
and runs are possessive, which changes no match because what follows a run is never in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from searchlab.llm.common import document_columns
from searchlab.sources.staging import stage

#: Base kinds in the order of the output, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email_bracketed", "phone_local", "account", "secret")
KINDS = BASE + ADDED
CONTEXT = 32
ROUNDS = 25
PART = 128  # matches whose positions are summed together

_MAIL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_bracketed": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "secret": r"(?<=[\"'])[A-Za-z0-9+/_-]{24,}+(?=[\"'])",
}
#: A text without this cannot hold the kind.
NEEDS = {
    "email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "email_bracketed": "[\\[(]\\x20?at",
    "phone_local": "[0-9]{3}[\\x20.-][0-9]{4}", "account": "[A-Z]{2}[0-9]{2}", "secret": "[\"']",
}
# Well-known words and prefixes.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at"
CUES = {
    "email": "mail|contact|write|reach|address|kontakt|correo|adresse",
    "ip": "ip|host|server|address|client|login|connect",
    "card": "card|visa|master|amex|credit|payment|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|contact|whatsapp|anruf|llama",
    "account": "iban|account|bank|konto|compte|cuenta",
    "secret": "token|secret|key|password|passwd|pwd|credential|auth",
}
CUES |= {"email_bracketed": CUES["email"], "phone_local": CUES["phone"]}
LABELERS = ("pattern", "gazetteer", "context", "border", "shape")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))

    def weighed(number: Column, place: Column) -> Column:
        twice = number * 2
        return F.when(place % 2 == 0, number).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(numbers, weighed), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return total % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        parts = F.transform(F.split(match, "[.]"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(
            parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise("999").cast("int") <= 255)
        )
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(F.length(match) < 16, False).when((n >= 16) & (n <= 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(kind: str, text: Column) -> Column:
    """array<struct<start, stop, match, before, after>> of a kind's pattern, in code points.

    ``before`` are the last ``CONTEXT`` characters in front of a match, ``after`` is the one behind it.
    Positions are running sums of the lengths of matches and of the text between them. An array grows by
    copying, so sums run inside of parts of ``PART`` matches first and over the parts then: the work
    is in proportion to the text, however many matches it has.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    none = F.array().cast("array<struct<start:int,stop:int,match:string,before:string,after:string>>")

    def step(state: Column, both: Column) -> Column:
        front = F.concat(state["tail"], both["gap"])
        start = state["at"] + F.length(both["gap"])
        stop = start + F.length(both["match"])
        span = F.struct(
            start.alias("start"), stop.alias("stop"), both["match"].alias("match"),
            F.substring(front, -CONTEXT, CONTEXT).alias("before"),
            F.substring(F.concat(F.coalesce(both["then"], F.lit("")), F.coalesce(both["next"], F.lit(""))), 1, 1).alias("after"),
        )
        return F.struct(
            stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"),
            F.substring(F.concat(front, both["match"]), -CONTEXT, CONTEXT).alias("tail"),
        )

    def one_part(pairs: Column, i: Column) -> Column:
        # A match has two characters or more, so these hold the context of the first match of the part.
        earlier = F.slice(pairs, F.greatest(i * PART + 1 - CONTEXT // 2, F.lit(1)), F.least(i * PART, F.lit(CONTEXT // 2)))
        tail = F.array_join(F.flatten(F.transform(earlier, lambda x: F.array(x["gap"], x["match"]))), "")
        empty = F.struct(
            F.lit(0).alias("at"), none.alias("spans"), F.substring(tail, -CONTEXT, CONTEXT).alias("tail")
        )
        return F.aggregate(F.slice(pairs, i * PART + 1, F.lit(PART)), empty, step)

    def in_parts(pairs: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PART).cast("int"))
        return F.transform(places, lambda i: one_part(pairs, i))

    def starts(parts: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            parts, first,
            lambda s, part: F.struct(
                (s["at"] + part["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")
            ),
            lambda s: s["starts"],
        )

    def moved(part: Column, by: Column) -> Column:
        # The text behind the last match has none of its own.
        return F.transform(
            F.filter(part["spans"], lambda x: x["match"].isNotNull()),
            lambda x: F.struct(
                (x["start"] + by).alias("start"), (x["stop"] + by).alias("stop"),
                x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"),
            ),
        )

    def zipped(both: Column) -> Column:
        rest = F.size(both["gap"])
        return F.arrays_zip(
            both["gap"].alias("gap"), both["match"].alias("match"),
            F.slice(both["gap"], F.lit(2), rest).alias("then"), F.slice(both["match"], F.lit(2), rest).alias("next"),
        )

    spans = _named(
        _named(F.struct(between.alias("gap"), found.alias("match")), zipped),
        lambda pairs: _named(in_parts(pairs), lambda parts: F.flatten(F.zip_with(parts, starts(parts), moved))),
    )
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(none)


def _votes(kind: str, match: Column, before: Column, after: Column, base: bool) -> Column:
    """One digit for each labeler: 1 for yes, 0 for no."""
    lower, digits = F.lower(match), _digits(match)
    base_kind = {"email_bracketed": "email", "phone_local": "phone"}.get(kind, kind)
    gazetteer = {
        "email": lower.rlike(rf"(?:\.|dot\x20?[\])]\x20?)(?:{DOMAINS})$"),
        "ip": ~match.rlike(r"^(?:0|10|127|255)\.|^192\.168\.|^1\.[0-9]\.[0-9]\.[0-9]$"),
        "card": digits.rlike("^[3-6]"),
        "phone": digits.rlike("^(?:1|3[0-9]|4[0-9]|5[0-9]{2}|[2-9])") & ~digits.rlike("^0+$"),
        "account": match.rlike("^(?:DE|FR|ES|IT|NL|GB|CH|AT|BE|PT)"),
        "secret": ~lower.rlike("^[a-z_-]+$"),
    }[base_kind]
    shape = {
        "email": F.length(match) <= 64,
        "ip": F.length(match) >= 7,
        "card": match.rlike(r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]+)$"),
        "phone": F.length(digits).between(10, 13),
        "account": F.length(match).between(15, 34),
        "secret": match.rlike("[0-9]") & match.rlike("[A-Za-z]"),
    }[base_kind]
    votes = (
        F.lit(base or kind != "secret"),
        gazetteer,
        F.lower(before).rlike(rf"(?:{CUES[kind]})"),
        before.rlike(r"(?:^|[\s:=(\"'<,])$") & after.rlike(r"^(?:$|[\s.,;:)\"'>!?])"),
        shape,
    )
    return F.concat(*(v.cast("int").cast("string") for v in votes))


def _features(match: Column) -> Column:
    """Span features of the classifier: length class, share of digits, separators."""
    return F.concat_ws(
        "/",
        F.least(F.floor(F.log2(F.length(match) + 1)), F.lit(7)).cast("string"),
        F.floor(F.length(_digits(match)) * 4 / F.length(match)).cast("string"),
        match.rlike(r"[\x20()-]").cast("int").cast("string"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its candidates: array<struct<kind, base, start, stop, votes, features>>."""
    source = document_columns(docs, id_col, text_col)
    text = F.col("text")
    raw = source.select("doc_id", "text", *(matches(k, text).alias(k) for k in KINDS))

    def described(kind: str) -> Column:
        base = kind in BASE

        def one(span: Column) -> Column:
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                span["start"].alias("start"), span["stop"].alias("stop"),
                _votes(kind, span["match"], span["before"], span["after"], base).alias("votes"),
                _features(span["match"]).alias("features"),
            )

        kept = F.filter(F.col(kind), lambda s: valid(kind, s["match"])) if base else F.col(kind)
        return F.transform(kept, one)

    parts = raw.select("doc_id", F.concat(*map(described, BASE)).alias("base"), F.concat(*map(described, ADDED)).alias("more"))

    def bounded(i: Column) -> Column:
        some = F.slice("base", i * PART + 1, F.lit(PART))
        low = F.array_min(F.transform(some, lambda b: b["start"]))
        return F.struct(low.alias("start"), F.array_max(F.transform(some, lambda b: b["stop"])).alias("stop"), some.alias("spans"))

    def meets(one: Column, other: Column) -> Column:
        return (one["start"] < other["stop"]) & (other["start"] < one["stop"])

    # Base spans come by kind and start, so an added one has to look into few parts only.
    spread = F.transform(F.sequence(F.lit(0), F.floor(F.size("base") / PART).cast("int")), bounded)
    apart = _named(spread, lambda some: F.filter(
        "more", lambda m: ~F.exists(some, lambda p: F.coalesce(meets(p, m), F.lit(False)) & F.exists(p["spans"], lambda b: meets(b, m))),
    ))
    return parts.select("doc_id", "base", apart.alias("more"))


def reliabilities(counts: DataFrame) -> DataFrame:
    """Posterior of each (kind, votes): expectation-maximisation over pattern counts.

    ``counts``: kind, votes, n. Each kind is one row here, with at most two to the number of
    labelers patterns. A labeler says yes with probability a on true spans and b on others;
    both start from the belief that labelers are better than chance. Returned: kind, votes,
    posterior, and the reliabilities ``yes_true`` and ``yes_false``.
    """
    patterns = counts.groupBy("kind").agg(
        F.collect_list(F.struct(F.transform(F.split("votes", ""), lambda v: v.cast("int")).alias("v"), F.col("n").cast("double").alias("n"), "votes")).alias("p")
    )
    k = len(LABELERS)

    def posterior(state: Column, pattern: Column) -> Column:
        def joint(prior: Column, chances: str) -> Column:
            return F.aggregate(
                F.zip_with(pattern["v"], state[chances], lambda v, c: F.when(v == 1, c).otherwise(1 - c)),
                prior, lambda a, b: a * b,
            )

        true, false = joint(state["prior"], "a"), joint(1 - state["prior"], "b")
        return true / (true + false)

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("p", lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), (p["n"] * posterior(state, p)).alias("t")))

        def total(of) -> Column:
            return F.aggregate(weighed, F.lit(0.0), lambda s, w: s + of(w))

        true, every = total(lambda w: w["t"]), total(lambda w: w["n"])
        places = F.sequence(F.lit(0), F.lit(k - 1))
        return F.struct(
            ((true + 1.0) / (every + 2.0)).alias("prior"),
            F.transform(places, lambda j: (total(lambda w: w["t"] * F.get(w["v"], j)) + 4.0) / (true + 5.0)).alias("a"),
            F.transform(places, lambda j: (total(lambda w: (w["n"] - w["t"]) * F.get(w["v"], j)) + 1.0) / (every - true + 5.0)).alias("b"),
        )

    start = F.struct(
        F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.8), k).alias("a"), F.array_repeat(F.lit(0.3), k).alias("b")
    )
    fitted = patterns.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    return fitted.select(
        "kind",
        F.explode(F.transform("p", lambda p: F.struct(p["votes"].alias("votes"), posterior(F.col("state"), p).alias("posterior")))).alias("x"),
        F.col("state.a").alias("yes_true"), F.col("state.b").alias("yes_false"),
    ).select("kind", "x.votes", "x.posterior", "yes_true", "yes_false")


def span_classifier(counts: DataFrame) -> DataFrame:
    """(kind, votes, features, odds): log-odds trained on expected labels.

    ``counts``: kind, votes, features, n. Every vote and every feature value has a weight, the
    smoothed log ratio of its expected true and false spans over all kinds; the kind gives the
    prior odds. The expected label itself comes in through the votes.
    """
    labels = reliabilities(counts.groupBy("kind", "votes").agg(F.sum("n").alias("n"))).select("kind", "votes", "posterior")
    rows = counts.join(labels, ["kind", "votes"]).withColumns({
        "t": F.col("n") * F.col("posterior"), "f": F.col("n") * (1 - F.col("posterior")),
    })
    prior = rows.groupBy("kind").agg(F.log((F.sum("t") + 1) / (F.sum("f") + 1)).alias("prior"))
    items = F.concat(
        F.transform(F.split("votes", ""), lambda v, j: F.concat_ws(":", F.lit("v"), j.cast("string"), v)),
        F.transform(F.split("features", "/"), lambda v, j: F.concat_ws(":", F.lit("f"), j.cast("string"), v)),
    )
    pieces = rows.select("kind", "votes", "features", "t", "f", F.explode(items).alias("item"))
    totals = rows.groupBy("kind").agg(F.sum("t").alias("all_t"), F.sum("f").alias("all_f"))
    weights = (
        pieces.groupBy("kind", "item").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
        .join(totals, "kind")
        .select("kind", "item", F.log((F.col("t") + 1) / (F.col("all_t") + 2) * (F.col("all_f") + 2) / (F.col("f") + 1)).alias("weight"))
    )
    return (
        pieces.join(weights, ["kind", "item"]).groupBy("kind", "votes", "features").agg(F.sum("weight").alias("weight"))
        .join(prior, "kind")
        .select("kind", "votes", "features", (F.col("weight") + F.col("prior")).alias("odds"))
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, BASE + ("email", "phone", "account", "secret")))
    return F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda s: F.struct(
                F.when(s["kind"] == 4, 0).when(s["kind"] == 5, 3).otherwise(s["kind"]).alias("order"),
                s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"),
            ))),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"]),
        ),
        ",",
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Spans are kind:start:end in code points, end exclusive, by kind and start. The counts and
    ``base_sha256`` cover base spans, ``spans`` also those that the classifier adds (bracketed addresses as
    email, local numbers as phone, then account and secret; none overlaps a base span). Null texts are empty;
    null ids stay, repeated rows are searched each, other columns are ignored, an empty
    table gives no rows.
    """
    rows = stage(candidates(docs, id_col, text_col), "candidates")
    every = rows.select(F.explode(F.concat("base", "more")).alias("s")).select("s.kind", "s.votes", "s.features")
    counts = stage(every.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "vote_patterns")
    accepted = span_classifier(counts).filter((F.col("odds") > 0) & (F.col("kind") >= len(BASE)))
    # At most one row for each kind, vote pattern and feature value.
    keys = [F.lit("|".join(map(str, r))) for r in accepted.select("kind", "votes", "features").collect()]
    known = F.array(*keys).cast("array<string>")
    added = F.filter("more", lambda m: F.array_contains(known, F.concat_ws("|", m["kind"], m["votes"], m["features"])))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id", *(number(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(F.col("base"), added)).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
    )
