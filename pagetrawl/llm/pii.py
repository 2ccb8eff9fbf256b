"""Personal data in texts: proposed by patterns, confirmed by checksums, scored by context (operator 1).

All of it is column expressions on one row: no shuffle and no Python. Each kind has a
pattern; the spans of its leftmost non-overlapping matches follow from the texts between
them (``split``) and the matches themselves (``regexp_extract_all``). A validator confirms a
match or drops it, and a context word near by raises its score. Positions are code points.

The patterns are written without backtracking (possessive, and anchored where a run of
their characters begins), so that texts of any length take linear time and no deep stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a span in which a context word counts.
NEAR = 40
#: Spans below this score are dropped.
LEAST_SCORE = 0.5
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits ends in its Luhn check digit."""

    def add(total, k):
        d = F.substr(number, -k, F.lit(1)).cast("int") * (2 - k % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number (two letters, two check digits, the rest) is 1 modulo 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def add(total, c):
        n = F.ascii(c)
        return F.when(n < 58, total * 10 + n - 48).otherwise(total * 100 + n - 55) % 97

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


#: Characters of an account number by country, and the longest match of such a number with a space before any of them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN_LONGEST = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+"


def iban_end(text: Column, start: Column) -> Column:
    """Where the account number that begins at ``start`` ends, or null: one of the ends of a word by which mod-97 holds.

    The one of the country's length goes first, then the longest; countries that are not listed can have any length.
    """
    body = F.regexp_extract(F.substr(text, start + 1, F.lit(64)), IBAN_LONGEST, 0)
    goes_on = F.substr(text, start + F.length(body) + 1, F.lit(1)).rlike("[A-Za-z0-9]")
    closed = F.concat(body, F.when(goes_on, "x").otherwise(" "))
    size = F.element_at(F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, n)]), F.substr(body, F.lit(1), F.lit(2)))

    def account(k):
        return F.regexp_replace(F.substr(body, F.lit(1), k), r"\x20", "")

    ends = F.filter(F.sequence(F.lit(15), F.greatest(F.length(body), F.lit(15))), lambda k: (F.substr(closed, k + 1, F.lit(1)) == " ") & (F.length(account(k)) >= 15))
    fine = F.filter(ends, lambda k: mod_97(account(k)))
    best = F.array_max(F.transform(fine, lambda k: F.struct(F.coalesce(F.length(account(k)) == size, F.lit(False)).alias("usual"), k.alias("k"))))
    return start + best["k"]


def small_parts(ip: Column) -> Column:
    bare = F.transform(F.split(ip, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(bare, lambda x: (F.length(x) <= 3) & (F.coalesce(F.substr(x, F.lit(1), F.lit(3)).cast("int"), F.lit(0)) <= 255))


@dataclass(frozen=True)
class Kind:
    """How one kind is proposed, confirmed and scored; ``needs`` is a character of every match.

    With ``ends`` the pattern matches the beginning only, and the span goes on to what ``ends`` makes of the text and
    its start, if that is not null; no such span begins within another one.
    """

    name: str
    pattern: str
    score: float
    words: str
    valid: Callable[[Column], Column] | None = None
    needs: str = ""
    ends: Callable[[Column, Column], Column] | None = None


KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.8, "mail|contact|write to", needs="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|host|server|address", small_parts, "."),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){11,}+", 0.7, "card|visa|credit|debit|payment",
        lambda m: (F.length(digits(m)) <= 19) & luhn(digits(m)),
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax",
        lambda m: F.length(digits(m)).between(9, 15), "+",
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11}+)", 0.7, "iban|account|bank", ends=iban_end,
    ),
    # a long hexadecimal word is private only where a context word says so
    Kind("key", r"(?<![0-9A-Za-z])[0-9a-f]{32,128}+(?![0-9A-Za-z])", 0.3, "token|secret|password|api.?key"),
)
BASE = ("email", "ip", "card", "phone")


def find_spans(text: Column, found: Column, kind: Kind, rank: int) -> Column:
    """Spans of the confirmed matches of one kind, scored; ``found`` are all its matches in turn."""
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    both = F.zip_with(gaps, found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def near(start, end):
        before = F.substr(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR)))
        around = F.concat_ws("\n", before, F.substr(text, end + 1, F.lit(NEAR)))
        return F.lower(around).rlike(kind.words)

    def add(state, x):
        start = state["at"] + x["gap"]
        over = start + F.length(x["m"])
        end = kind.ends(text, start) if kind.ends else over
        score = F.lit(kind.score) + F.when(near(start, end), 0.25).otherwise(0.0)
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score")
        )
        fine = x["m"].isNotNull() & (kind.valid(x["m"]) if kind.valid else F.lit(True))
        if kind.ends:
            fine = fine & (start >= F.coalesce(F.get(state["spans"], F.size(state["spans"]) - 1)["end"], F.lit(0))) & end.isNotNull()
        grown = F.when(fine, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(F.coalesce(over, start).alias("at"), grown.alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    spans = F.aggregate(both, first, add)["spans"]
    kept = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast(SPAN))


def pii_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``pii``: all spans of its text, ordered by start, then by kind as listed.

    A span has start, end (exclusive), kind, score and the kind's rank. Null and empty texts have
    none. Repeated rows are treated alike. Columns named like the helpers below are kept out of their way.
    """
    text = F.coalesce("text", F.lit(""))
    taken, names = {c.lower() for c in docs.columns}, {}
    for k in kinds:
        names[k.name] = f"__{k.name}"
        while names[k.name].lower() in taken:
            names[k.name] += "_"

    def matches(k: Kind) -> Column:
        found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        return F.when(F.contains(text, F.lit(k.needs)), found).otherwise(F.array().cast("array<string>")) if k.needs else found

    proposed = docs.withColumns({names[k.name]: matches(k) for k in kinds})
    spans = F.concat(*[find_spans(text, F.col(names[k.name]), k, rank) for rank, k in enumerate(kinds)])
    return proposed.withColumn("pii", F.array_sort(spans)).drop(*names.values())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""

    def add(state, s):
        start = F.greatest(s["start"], state["at"])
        fresh = s["end"] > state["at"]
        mark = F.when(s["start"] >= state["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        grown = F.concat(state["out"], F.substr(text, state["at"] + 1, start - state["at"]), mark)
        return F.when(fresh, F.struct(s["end"].alias("at"), grown.alias("out"))).otherwise(state)

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(spans, first, add, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
