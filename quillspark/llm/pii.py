r"""Personal data (native): patterns propose spans, checksums confirm them, context scores them.

Positions come from cutting the text by the pattern: piece and match lengths, added
up, give every start and end in code points. Context is what stands within CONTEXT_CHARS code points of the whole text,
other matches included. Patterns are written so that no input
makes them slow: possessive or short bounded repeats, and a look-behind so that a run
that failed is not tried again from within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, quoted

#: Kinds every scan reports, in the order of ties; then what this method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED

#: Characters of an account number, by country; what follows it after a space is not part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
# Word ends are those of ASCII text, so that they mean the same in every regular-expression dialect.
_BEGIN, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}{{end}}" for n, c in IBAN_LENGTHS.items())


def iban_pattern(begin: str, end: str, ahead: str = "") -> str:
    """Account numbers of known countries at their length, of others at any."""
    known = _BY_COUNTRY.replace("{end}", end)
    return rf"{begin}{ahead}(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}{end})"


# What the kinds look like.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern(_BEGIN, _END, "(?=[A-Z]{2}[0-9]{2})"),
    "ssn": rf"{_BEGIN}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
}
#: A text without this holds none of the kind.
TRIGGERS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
#: Words that make a kind likelier when they stand near.
CONTEXT = {
    "email": "mail|e-mail|email|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|mobile|call|fax|whatsapp",
    "iban": "iban|bank|account|transfer|bic|swift",
    "ssn": "ssn|social|security|taxpayer",
}
#: Words that make a kind less likely when they stand near.
AGAINST = {
    "email": "example|sample|noreply",
    "ip": "version|release|section",
    "card": "order|isbn|serial|tracking",
    "phone": "isbn|serial|version",
    "iban": "serial|sample|example",
    "ssn": "serial|part|order|version",
}
#: Score in hundredths before context; a confirmed checksum is most of it.
PRIOR = {"email": 70, "ip": 60, "card": 80, "phone": 60, "iban": 80, "ssn": 40}
BONUS, PENALTY, CONTEXT_CHARS, REPORT_FROM = 20, 35, 40, 50


def pieces(text: Column, pattern: str) -> Column:
    """Leftmost matches of ``pattern`` with what stands around: array of hit, gap (since the match before), before (the end of the gap), after (what follows in the text)."""
    hits, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    after = F.regexp_extract_all(text, F.lit(rf"{pattern}(?=((?s:.{{0,{CONTEXT_CHARS}}})))"), F.lit(1))
    near = F.transform(
        F.arrays_zip(hits.alias("h"), rest.alias("b"), after.alias("a")),
        lambda x: F.struct(x["h"].alias("hit"), F.length(x["b"]).cast("bigint").alias("gap"), F.right(x["b"], F.lit(CONTEXT_CHARS)).alias("before"), x["a"].alias("after")),
    )
    return F.filter(near, lambda x: x["hit"].isNotNull())


def chunked(near: Column) -> Column:
    """``pieces`` in chunks of about the square root of their number; ``near`` must be a column."""
    n = F.size(near)
    step = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, step), lambda i: F.slice(near, i, step))).otherwise(F.array().cast(f"array<array<{_PIECE}>>"))


def placed(chunks: Column) -> Column:
    """``pieces`` with start and end in code points, and before reaching over earlier matches; ``chunks`` must be a column.

    Running sums, and the last characters so far, are taken over chunks, then within each: a fold that appends to its result
    copies it each time, and so no array that is built this way is longer than a chunk.
    """
    width = lambda x: x["gap"] + F.length(x["hit"])
    last = lambda *parts: F.right(F.concat(*parts), F.lit(CONTEXT_CHARS))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail"))
    add = lambda s, x: F.struct((s["at"] + width(x)).alias("at"), last(s["tail"], x["before"], x["hit"]).alias("tail"))
    totals = F.transform(chunks, lambda c: F.aggregate(c, begin, add))
    offsets = F.aggregate(
        totals,
        F.struct(begin.alias("now"), F.array().cast("array<struct<at:bigint,tail:string>>").alias("out")),
        lambda s, v: F.struct(F.struct((s["now"]["at"] + v["at"]).alias("at"), last(s["now"]["tail"], v["tail"]).alias("tail")).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")),
        lambda s: s["out"],
    )
    kind = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.length(x["hit"])
        before = last(s["tail"], x["before"])
        found = F.struct(start.alias("start"), end.alias("end"), x["hit"], before.alias("before"), x["after"])
        return F.struct(end.alias("at"), last(before, x["hit"]).alias("tail"), F.concat(s["out"], F.array(found)).alias("out"))

    first = lambda at: F.struct(at["at"].alias("at"), at["tail"].alias("tail"), F.array().cast(kind).alias("out"))
    return F.flatten(F.zip_with(chunks, offsets, lambda c, at: F.aggregate(c, first(at), step, lambda s: s["out"])))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the ISO 7064 mod-97 check."""
    turned = F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    if kind == "ssn":
        return ~hit.rlike(r"^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _stands_alone(kind: str, x: Column) -> Column:
    """An ssn is no part of a longer number with hyphens."""
    return ~(F.right(x["before"], F.lit(1)) == "-") & ~(F.left(x["after"], F.lit(1)) == "-") if kind == "ssn" else F.lit(True)


_PIECE = "struct<hit:string,gap:bigint,before:string,after:string>"
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,hit:string,score:double>>"


def kind_spans(found: Column, kind: str) -> Column:
    """Confirmed spans of one kind among ``placed`` matches, scored."""

    def as_span(x: Column) -> Column:
        around = F.concat_ws(" ", x["before"], x["after"])
        said = lambda words, by: F.when(around.rlike(rf"(?i){_BEGIN}(?:{words}){_END}"), by).otherwise(0)
        score = (F.lit(PRIOR[kind]) + said(CONTEXT[kind], BONUS) - said(AGAINST[kind], PENALTY)) / 100
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"), score.alias("score"))

    spans = F.transform(F.filter(found, lambda x: confirmed(kind, x["hit"]) & _stands_alone(kind, x)), as_span)
    if kind in ADDED:
        spans = F.filter(spans, lambda s: s["score"] * 100 >= REPORT_FROM)
    return spans.cast(_SPANS)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of start, rank (place in KINDS), end, kind, hit, score (0 to 1), by start, then rank.

    Matches that fail their check are dropped, with no second try inside them. Kinds of
    BASE are always reported; added ones from a score of REPORT_FROM hundredths: an ssn takes a
    context word, an iban none that speaks against it. A null or empty text has no spans; rows that
    repeat are scanned each; an empty table gives an empty result. Time is linear in a text's
    length, and nearly so in its matches. All columns of ``docs`` pass through; one named ``pii`` is replaced.
    """
    own, name = docs.columns, {k: fresh(k) for k in ("said", *KINDS)}
    said = docs.withColumn(name["said"], F.coalesce(F.col(text), F.lit("")))
    whole = F.col(name["said"])
    may = lambda kind: (whole.contains(TRIGGERS[kind]) if TRIGGERS[kind] else F.lit(True)) & whole.rlike(PATTERNS[kind])
    # Each step is a column of its own, so that no lambda evaluates another step again for each element.
    near = said.withColumns({name[k]: F.when(may(k), pieces(whole, PATTERNS[k])).otherwise(F.array().cast(f"array<{_PIECE}>")) for k in KINDS})
    cut = near.withColumns({name[k]: chunked(F.col(name[k])) for k in KINDS})
    done = cut.withColumn("pii", F.sort_array(F.concat(*(kind_spans(placed(F.col(name[k])), k) for k in KINDS))))
    return done.select(*quoted(docs), *(["pii"] if "pii" not in own else []))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scores_text(spans: Column) -> Column:
    """Scores in hundredths, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
