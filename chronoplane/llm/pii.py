"""Personal data in texts, found with SQL expressions only.

Regular expressions propose spans. Validators confirm them: parts of addresses up to 255, Luhn sums for cards, digit
counts for phones, mod-97 for bank account numbers. Words near a span, on either side of it, raise its score. Base
kinds (email, ip, card, phone) are reported whenever valid; the kinds this method adds (iban, secret) only from a score
of ``THRESHOLD``, which none of them reaches without such a word.

The expressions below match what the plain ones do, leftmost and not overlapping, in time linear in the text: a match
starts at the first character of its run, or where the one before it ended, and inner repetitions are possessive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Patterns of the kinds, in the order in which spans are listed.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
# A country's fixed length first, so that words after a number are left for what follows; else any length.
_FIXED = "|".join(
    rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])"
    for n, c in IBAN_LENGTHS.items()
)
IBAN = rf"(?<![A-Za-z0-9])(?:{_FIXED}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
KINDS = ("email", "ip", "card", "phone", "iban", "secret")

# Beginnings of words that raise a span's score when they stand near it, and how far near is.
CONTEXT = {
    "email": "mail|e-mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "secret": "token|secret|password|passwd|pwd|credential|bearer|(?:api|access)?[_-]?keys?(?![a-z])",
}
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.5, "secret": 0.4}
BOOST, NEAR, THRESHOLD = 0.2, 40, 0.6

WALK = 64  # matches walked in one go

SPANS = "array<struct<s:int,e:int,m:string,left:string,right:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def proposed(text: Column, pattern: str) -> Column:
    """Start and end (code points) and string of each match, and the text near it on the left and on the right.

    Positions are running sums of lengths, taken in blocks of WALK matches from the sums of the blocks before. What is
    near comes from the pieces of text around a match, so nothing looks for a place in the whole text again.
    """

    def shifted(parts: Column, by: int, n: Column) -> Column:
        """The n elements from position ``by``, empty strings where there are none."""
        padded = F.concat(F.array_repeat(F.lit(""), max(-by, 0)), F.slice(parts, max(by, 0) + 1, F.greatest(n, F.lit(0))), F.array_repeat(F.lit(""), 2))
        return F.slice(padded, 1, F.greatest(n, F.lit(0)))

    def walked(items: Column, at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(SPANS).alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            left = F.right(F.concat(F.right(x["gap0"], F.lit(NEAR)), x["m0"], x["gap"]), F.lit(NEAR))
            right = F.left(F.concat(x["gap1"], x["m1"], F.left(x["gap2"], F.lit(NEAR))), F.lit(NEAR))
            span = F.struct(start.alias("s"), (start + F.length(x["m"])).alias("e"), x["m"].alias("m"), left.alias("left"), right.alias("right"))
            return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(items, begin, step, lambda acc: acc["spans"])

    def in_blocks(items: Column) -> Column:
        block = lambda b: F.slice(items, b * WALK + 1, F.lit(WALK))
        numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / F.lit(WALK)).cast("int"))
        long = F.transform(numbers, lambda b: F.aggregate(block(b), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["m"])))
        return bound(long, lambda sums: F.flatten(F.transform(numbers, lambda b: walked(block(b), F.aggregate(F.slice(sums, 1, b), F.lit(0), lambda n, x: n + x)))))

    def located(found: Column) -> Column:
        m, g = found["m"], found["g"]
        n = F.size(m)
        items = F.arrays_zip(
            m.alias("m"), shifted(m, -1, n).alias("m0"), shifted(m, 1, n).alias("m1"),
            shifted(g, 0, n).alias("gap"), shifted(g, -1, n).alias("gap0"), shifted(g, 1, n).alias("gap1"), shifted(g, 2, n).alias("gap2"),
        )
        return bound(items, lambda x: F.when(F.size(x) <= WALK, walked(x, F.lit(0))).otherwise(in_blocks(x)))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return bound(found, lambda x: F.when(F.size(x["m"]) > 0, located(x)).otherwise(F.array().cast(SPANS)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(d: Column, i: Column) -> Column:
        x = F.ascii(d) - 48
        doubled = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.when(i % 2 == 1, doubled).otherwise(x)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number, without spaces, leaves 1 when its rearranged digits are divided by 97."""
    turned = F.split(F.concat(F.substring(number, 5, 100), F.substring(number, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        x = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(x > 9, (acc * 100 + x) % 97).otherwise((acc * 10 + x) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def octets_fit(match: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": octets_fit,
    "card": lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit(""))),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}


def near_word(text: Column, kind: str) -> Column:
    """Whether a word that begins like one of the kind's context words is in a text."""
    return F.lower(text).rlike(f"(?<![a-z])(?:{CONTEXT[kind]})")


PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "secret": SECRET}
#: A cheap test that texts without any span of the kind mostly fail.
HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9][ -]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
    "secret": lambda t: near_word(t, "secret") & t.rlike("[0-9]"),
}


def valid_start(x: Column, kind: str) -> Column:
    """The longest valid start of a proposed span that ends where the span or a word of it does; null if there is none."""
    m = x["m"]
    cut = F.filter(
        F.sequence(F.lit(0), F.length(m) - 1),
        lambda k: ((k == 0) | (F.substring(m, F.length(m) - k + 1, F.lit(1)) == " ")) & VALID[kind](F.substring(m, F.lit(1), F.length(m) - k)),
    )
    k = F.get(cut, F.lit(0))
    return F.when(k.isNotNull(), F.struct(x["s"].alias("s"), (x["e"] - k).alias("e"), F.substring(m, F.lit(1), F.length(m) - k).alias("m"), x["left"].alias("left"), x["right"].alias("right")))


def spans_of(text: Column, kind: str) -> Column:
    """The valid spans of one kind with their scores."""
    found = F.when(HINT[kind](text), proposed(text, PATTERN[kind])).otherwise(F.array().cast(SPANS))
    if kind == "iban":
        good = F.filter(F.transform(found, lambda x: valid_start(x, kind)), lambda x: x.isNotNull())
    else:
        good = F.filter(found, lambda x: VALID[kind](x["m"]))

    def scored(x: Column) -> Column:
        near = near_word(x["left"], kind) | near_word(x["right"], kind)
        score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near, F.lit(BOOST)).otherwise(F.lit(0.0)))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), F.round(score, 2).alias("score"))

    return F.transform(good, scored)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``pii_spans``: (kind, start, end, score) by kind, then start; code points, end exclusive.

    Null and empty texts have an empty list. All other columns stay; one named ``pii_spans`` is replaced. Repeated
    rows get equal lists. Very long texts cost time linear in their length; their spans are walked in blocks.
    """
    text = text_or_empty(text_col)
    parts = [spans_of(text, k) for k in ("email", "ip", "card", "phone")]
    added = [F.filter(spans_of(text, k), lambda x: x["score"] >= THRESHOLD) for k in ("iban", "secret")]
    return docs.withColumn("pii_spans", F.concat(*parts, *added))


def span_list(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    chosen = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_secret, scores) of every document.

    ``scores`` lists the spans' scores in the order of ``spans``.
    """
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    count = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = span_list(F.col("pii_spans"), ("email", "ip", "card", "phone"))
    scores = F.array_join(F.transform("pii_spans", lambda x: x["score"].cast("string")), ",")
    return found.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(F.col("pii_spans")).alias("spans"),
        *map(count, ("iban", "secret")), scores.alias("scores"),
    )


def masked_text(docs: DataFrame) -> DataFrame:
    """docs whose text has every span replaced by its kind in brackets; overlapping spans become one.

    Expects ``pii_spans`` of ``find_pii`` and drops it. Texts without spans, null ones too, stay as they are.
    """
    text = text_or_empty()
    ordered = F.array_sort(F.transform("pii_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        new = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), label))
        apart = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(apart, new).otherwise(acc["parts"]).alias("parts"))

    masked = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return docs.withColumn("text", F.when(F.size("pii_spans") > 0, masked).otherwise(F.col("text"))).drop("pii_spans")
