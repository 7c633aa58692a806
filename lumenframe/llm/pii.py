"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything happens inside the row with SQL functions, so there is no shuffle and no Python. Match positions come from
the pieces between matches: the k-th match starts after the first k pieces and the first k - 1 matches. Running sums go
in blocks of about the root of their number, so a text of very many spans costs little more than one of few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, text_or_empty

# The base expressions, in the order in which kinds are listed. Quantifiers are possessive where the next
# part cannot begin with what they take, so long runs need neither backtracking nor stack; "\G or no such character
# before" keeps a long run from being tried again from each of its characters.
LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: For each kind: start score, and the words that raise or lower the score when they stand near.
CONTEXT = {
    "email": (0.8, r"mail|contact|write", r"example|test"),
    "ip": (0.6, r"\bip\b|host|server|address|login", r"version|release|section"),
    "card": (0.7, r"card|visa|credit|pay", r"order|invoice|part|test"),
    "phone": (0.7, r"tel|phone|call|mobile|fax", r"order|invoice|part|test"),
    "iban": (0.3, r"iban|bank|account|konto|cuenta|compte", r"test|example|sample"),
    "ssn": (0.4, r"ssn|social|security|tax", r"order|invoice|part|test"),
    "secret": (0.5, r"secret|private|prod|credential|login", r"example|dummy|placeholder|sample"),
    "key": (0.8, r"key|secret|token", r"example|dummy|placeholder|sample"),
}
#: Spans that the method adds: named secrets with a value, and keys of known form, beside two numbers with rules of their own.
ADDED = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)[a-z_-]{0,20}[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?[a-z0-9+/_.=-]{12,}+",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|[rs]k_live_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*+)|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
KINDS = {**BASE, **ADDED}
#: What must occur in a text for an expression to be tried at all; a cheap scan.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.contains("."),
    "card": lambda t: t.rlike("[0-9][0-9]|[0-9][ -][0-9]"),
    "phone": lambda t: t.contains("+"),
    "ssn": lambda t: t.contains("-"),
    "secret": lambda t: t.contains("=") | t.contains(":"),
}
CONTEXT_CHARS, CONTEXT_STEP, CHECK_STEP, KEEP_FROM = 40, 0.3, 0.4, 0.6

NO_SPANS = "array<struct<start:int,ord:int,kind:string,end:int,m:string,score:double>>"


def _running(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or another ``op``) of an array with at least one number, each with its own one."""
    plain = lambda a: F.aggregate(a, F.array().cast("array<int>"), lambda out, x: F.concat(out, F.array(F.when(F.size(out) > 0, op(F.element_at(out, -1), x)).otherwise(x))))

    def blocks(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1), lambda i: plain(F.slice(a, i * width + 1, width)))
        return bound(parts, lambda p: bound(plain(F.transform(p, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: op(F.get(ends, i - 1), y)))))))

    return bound(numbers, blocks)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """True if the string of digits passes the Luhn check: from the right, each second digit doubled."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    twice = lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(chars, twice), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """True if the account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(iban, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _octets_ok(m: Column) -> Column:
    part = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3) <= "255")
    return F.forall(F.split(m, r"\."), part)


def _base_ok(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets_ok(m)
    n = F.char_length(_digits(m))
    if kind == "card":
        return n.between(14, 19) & luhn_ok(_digits(m))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _checked(kind: str, m: Column) -> Column:
    """What the method's own check adds to the score of a kind."""
    if kind == "iban":
        return F.when(mod97_ok(m), CHECK_STEP).otherwise(-1.0)
    if kind == "secret":  # a value of letters and digits is hardly a word
        return F.when(m.rlike(r"(?i)[:=].*[0-9]") & m.rlike(r"(?i)[:=].*[a-z]"), 0.2).otherwise(-0.2)
    return F.lit(0.0)


def _spans(text: Column, kind: str) -> Column:
    """All matches, leftmost first and not overlapping: start, ord, kind, end (code points, exclusive), m and score.

    The words around a match are those between it and its neighbours of the same kind, 40 characters on each side at most.
    """
    pattern, order = KINDS[kind], list(KINDS).index(kind)
    base, near, against = CONTEXT[kind]
    none = F.expr(f"cast(array() as {NO_SPANS})")

    def placed(x: Column) -> Column:
        found, pieces = x["found"], x["pieces"]
        sizes = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m))
        rows = lambda ends: F.arrays_zip(found.alias("m"), ends.alias("end"), F.slice(pieces, 1, F.size(found)).alias("left"), F.slice(pieces, 2, F.size(found)).alias("right"))

        def one(r: Column) -> Column:
            around = F.lower(F.concat(F.right(r["left"], F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(r["right"], F.lit(CONTEXT_CHARS))))
            score = F.lit(base) + _checked(kind, r["m"]) + F.when(around.rlike(near), CONTEXT_STEP).otherwise(0.0) - F.when(around.rlike(against), CONTEXT_STEP).otherwise(0.0)
            return F.struct((r["end"] - F.char_length(r["m"])).alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), r["end"].alias("end"), r["m"].alias("m"), F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2).alias("score"))

        good = (lambda r: _base_ok(kind, r["m"])) if kind in BASE else (lambda r: F.lit(True))
        spans = F.transform(F.filter(_running_sum(sizes, rows), good), one)
        return F.when(F.size(found) > 0, spans).otherwise(none)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    told = bound(both, placed)
    told = F.when(NEEDS[kind](text), told).otherwise(none) if kind in NEEDS else told
    return told if kind in BASE else F.filter(told, lambda s: s["score"] >= KEEP_FROM)


def _running_sum(sizes: Column, use: Callable[[Column], Column]) -> Column:
    return bound(_running(sizes, lambda a, b: a + b), use)


def _found(text: Column) -> tuple[Column, Column]:
    base = F.array_sort(F.concat(*[_spans(text, k) for k in BASE]))
    return base, F.concat(*[_spans(text, k) for k in ADDED])


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``base_spans`` and ``pii_spans``: arrays of structs (start, ord, kind, end, m, score), by start and kind.

    Base spans need only their own check. Added kinds begin with a score, gain or lose by their check and by words within
    40 characters, and stay from 0.6 upwards; base spans carry a score as well, which decides nothing. A null or empty
    text has no spans; a very long one, or one of very many spans, is taken whole. One row out for each row in, repeated
    rows too, none for an empty table; columns of the two names are replaced, others pass through, whatever their names.
    """
    docs = docs.drop("base_spans", "pii_spans")
    rows = docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))
    base, more = _found(F.col("text"))
    rows = rows.select("row", base.alias("base_spans"), more.alias("more"))
    return rows.select("row.*", "base_spans", F.array_sort(F.concat("base_spans", "more")).alias("pii_spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``find_pii`` in the text replaced by ``<kind>``; of spans that overlap, one mark stands for all, of the first one's kind.

    A null or empty text stays as it is; very long ones are masked whole; rows that repeat give equal rows; an empty table
    stays empty. Columns named like the spans are dropped, others pass through.
    """
    docs = docs.drop("base_spans", "pii_spans")
    rows = find_pii(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "pii_spans", text_or_empty().alias("t"))

    def masked(x: Column) -> Column:
        chars, spans = x["chars"], x["spans"]
        cut_out = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")

        def written(upto: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(upto, i - 1))
            marks = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(cut_out(before(i), s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
            return F.concat(F.array_join(marks, ""), cut_out(F.element_at(upto, -1), F.size(chars)))

        return bound(_running(F.transform(spans, lambda s: s["end"]), F.greatest), written)

    new = F.when(F.size("pii_spans") > 0, bound(F.struct(F.split("t", "").alias("chars"), F.col("pii_spans").alias("spans")), masked)).otherwise(F.col("row.text"))
    return rows.select("row", new.alias("t")).select(*[F.col("t").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows; further columns: the numbers of the added kinds and of all spans, and the score of each span."""
    count = lambda of, kind: F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    found = find_pii(docs.select("doc_id", "text"))
    scores = F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",")
    return found.select(
        "doc_id", *[count("base_spans", k) for k in BASE], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"),
        *[count("pii_spans", k) for k in ADDED], F.size("pii_spans").cast("bigint").alias("n_spans"), scores.alias("scores"),
    )
