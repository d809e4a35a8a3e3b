"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

Native column expressions throughout.  The patterns carry a start condition, (?:\\G|(?<!class)): a
match can only begin where a run of its first class begins or where the last match ended, which
leaves the matches as they are and keeps long runs linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import digits, let, matches, of_kind, written

#: Kind, pattern, a cheap condition, in order of rank.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
BASE = ("email", "ip", "card", "phone")
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "address|host|server|login|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|tél",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "local_phone": "phone|call|tel|mobile|fax|telefon|tél",
}
#: Score of a pattern alone, what a checksum adds, what a context word adds, least score.
SHAPE = {"email": 0.7, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "local_phone": 0.4}
CHECKED, NEAR, LEAST = 0.4, 0.2, 0.6


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    total = F.aggregate(
        F.split(F.reverse(number), ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("sum")),
        lambda acc, c: F.struct(
            (acc["at"] + 1).alias("at"),
            (acc["sum"] + F.when(acc["at"] % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right: its first four characters moved to the end and
    letters written as 10 to 35, the number is 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return (
        F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1
    )


def _ip_parts(match: Column) -> Column:
    """Whether all four numbers are at most 255, whatever zeros they begin with."""
    plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(match, "\\."), lambda p: (F.char_length(plain(p)) <= 3) & (F.lpad(plain(p), 3, "0") <= "255"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 40, block: int = 64) -> DataFrame:
    """One row per input row: key, base (spans of the four base kinds), found (all spans), each an
    array of (start, rank, end, kind, match, score), by start and then rank.

    A null text is empty; repeated rows and null keys are rows like any other; whole texts are
    searched however long; an empty table gives an empty one.  Base kinds are
    decided by pattern and checksum alone and always stay; an IBAN needs its checksum, a phone
    number without country code a context word within ``window`` characters.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    email = matches(t, EMAIL, "email", 0, "@")
    ip = F.filter(matches(t, IP, "ip", 1, r"[0-9]\.[0-9]"), lambda s: _ip_parts(s["match"]))
    card = F.filter(
        matches(t, CARD, "card", 2, r"[0-9](?:[\x20-]?[0-9]){13}"),
        lambda s: F.char_length(digits(s["match"])).between(14, 19) & luhn(digits(s["match"])),
    )
    phone = F.filter(matches(t, PHONE, "phone", 3, r"\+[0-9]"), lambda s: F.char_length(digits(s["match"])).between(10, 15))
    iban = F.filter(matches(t, IBAN, "iban", 4, "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"), lambda s: mod97(s["match"]))
    local = matches(t, LOCAL_PHONE, "local_phone", 5, r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]")

    def scored(spans: Column, kind: str) -> Column:
        checked = CHECKED if kind in ("card", "iban") else 0.0

        def of(s: Column, piece: Column, before: Column) -> Column:
            """The score of a span by the context in the piece of text that follows ``before`` code points."""
            begin = F.greatest(s["start"] - window, F.lit(0))
            near = F.lower(F.substring(piece, begin - before + 1, s["end"] + window - begin)).rlike(CONTEXT[kind])
            return s.withField("score", F.round(F.lit(SHAPE[kind] + checked) + F.when(near, NEAR).otherwise(0.0), 3))

        def over_block(own: Column) -> Column:
            """A place in a text is counted from its start, so the text around a block of spans is cut out first."""
            before = F.greatest(own[0]["start"] - window, F.lit(0))
            cut = F.struct(F.substring(t, before + 1, F.element_at(own, -1)["end"] + window - before).alias("piece"), before.alias("before"))
            return let(cut, lambda c: F.transform(own, lambda s: of(s, c["piece"], c["before"])))

        def over_blocks(found: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int")), lambda i: F.slice(found, i * block + 1, F.lit(block)))
            return F.flatten(F.transform(blocks, over_block))

        none = lambda found: F.transform(found, lambda s: s.withField("score", F.lit(0.0)))
        return let(spans, lambda found: F.when(F.size(found) > 0, over_blocks(found)).otherwise(none(found)))

    kinds = {"email": email, "ip": ip, "card": card, "phone": phone, "iban": iban, "local_phone": local}
    own = {k: scored(v, k) for k, v in kinds.items()}
    rows = docs.select(F.col(key).alias(key), *(v.alias(f"_{k}") for k, v in own.items()))
    apart = lambda s: ~F.exists("_phone", lambda p: (p["start"] < s["end"]) & (s["start"] < p["end"]))
    more = F.filter(F.concat("_iban", "_local_phone"), lambda s: (s["score"] >= LEAST) & apart(s))
    base = F.concat(*(f"_{k}" for k in BASE))
    return rows.select(key, F.array_sort(base).alias("base"), F.array_sort(F.concat(base, more)).alias("found"))


def digest_rows(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key, *(of_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans")
    )
