"""Secrets in texts: known shapes, and sliding-window entropy over candidate strings.
Only DataFrame functions: no Python runs on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes searched for, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that are no secrets: UUIDs, and texts around a placeholder.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|abcdefghijkl|0123456789",
)
#: Candidates that are paths of words. Only their last part can hold a secret. The
#: group is possessive: Java matches any other repeated group by recursion.
PATH = r"^/?(?:[A-Za-z_-]+/)++[A-Za-z0-9_-]*$"

WINDOW = 20
#: Least bits a character by class; the largest possible value is log2(20) = 4.32.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Entropies are compared as whole numbers of this unit, so that sums are exact.
UNIT = 1_000_000


def _weight(count: int) -> int:
    return round(count * math.log2(count) * UNIT) if count else 0


def most_weight(bits: float) -> int:
    """Sum of count * log2(count) in a window of ``bits`` bits a character."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda function uses it
    for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, zero: Column, join: Callable[[Column, Column], Column], base: int = 64) -> Column:
    """What ``join`` makes of all values before each one. Values are folded in blocks,
    and those in blocks again, so the work grows with their number only."""

    def fold(v: Column, start: Column, size: Column) -> Column:
        return F.aggregate(F.slice(v, start + 1, size), zero, join)

    def inside(v: Column) -> Column:
        return F.transform(v, lambda _, i: fold(v, i - i % base, i % base))

    def blocks(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / base).cast("int")), lambda b: fold(v, b * base, F.lit(base))
        )

    def placed(v: Column, first: Column, second: Column, third: Column) -> Column:
        far = lambda i, size: F.floor(i / size).cast("int")
        return F.transform(
            first, lambda x, i: join(join(x, F.get(second, far(i, base))), F.get(third, far(i, base * base)))
        )

    def all_levels(v: Column) -> Column:
        return _let(
            blocks(v),
            lambda one: _let(
                blocks(one),
                lambda two: _let(
                    F.struct(
                        inside(v).alias("a"),
                        inside(one).alias("b"),
                        F.transform(two, lambda _, i: fold(two, F.lit(0), i)).alias("c"),
                    ),
                    lambda x: placed(v, x["a"], x["b"], x["c"]),
                ),
            ),
        )

    return _let(values, lambda v: F.when(F.size(v) > 0, all_levels(v)).otherwise(v))


def _spans(found: Column, gaps: Column, order: int) -> Column:
    """Spans of matches from the text between them: array of (start, kind, end)."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def placed(sizes: Column) -> Column:
        both = F.transform(sizes, lambda x: x["gap"] + x["size"])
        return _let(
            _before(both, F.lit(0), lambda a, b: a + b),
            lambda at: F.transform(
                sizes,
                lambda x, i: F.struct(
                    (F.get(at, i) + x["gap"]).alias("start"), F.lit(order).alias("kind"), (F.get(at, i) + x["gap"] + x["size"]).alias("end")
                ),
            ),
        )

    sizes = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    return F.when(F.size(found) > 0, _let(sizes, placed)).otherwise(none)


#: Symbols whose counts share a long, and the bits of a count.
PER_LONG, BITS = 12, 5
#: Counts of a window that decide its class: hexadecimal digits, letters, digits and
#: signs of numbers, slashes.
CLASSES = ("0123456789abcdefABCDEF", ALPHABET[:52], "0123456789+/", "/")


def _entropy_range(text: Column, is_path: Column) -> Column:
    """First and last start of a window whose entropy reaches the limit of its class.

    The counts of a window come from those of the window before: one symbol enters and
    one leaves. They lie packed in longs, so a step costs the same for any alphabet.
    Windows of letters only are words and those without letters numbers; both are
    allowed, and so are the windows of a path that hold a slash.
    """
    weights = [_weight(i) for i in range(WINDOW + 1)]
    gains = F.array(*[F.lit(weights[i + 1] - weights[i]) for i in range(WINDOW)])
    longs = -(-len(ALPHABET) // PER_LONG)
    units = F.array(*[F.lit(1 << BITS * (c % PER_LONG)).cast("long") for c in range(len(ALPHABET))])
    kinds = F.array(*[F.lit(sum((c in k) << BITS * i for i, k in enumerate(CLASSES))) for c in ALPHABET])
    least = (1 << BITS) - 1

    def count(n: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(n, F.floor(c / PER_LONG).cast("int")), BITS * (c % PER_LONG)).bitwiseAND(F.lit(least).cast("long")).cast("int")

    def part(kind: Column, i: int) -> Column:
        return F.shiftright(kind, BITS * i).bitwiseAND(F.lit(least))

    def scan(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, i - WINDOW)

            def moved(x: Column) -> Column:
                e, z, n = x["e"], x["z"], state["n"]
                left = F.when(z.isNull(), 0).otherwise(F.get(gains, count(n, z) - 1))
                had = count(n, e) - F.when(z == e, 1).otherwise(0)
                unit = lambda c, k: F.when(F.floor(c / PER_LONG) == k, F.get(units, c)).otherwise(F.lit(0).cast("long"))
                return F.struct(
                    F.transform(n, lambda v, k: v + unit(e, k) - unit(z, k)).alias("n"),
                    (state["sum"] - left + F.get(gains, had)).alias("sum"),
                    (state["kind"] + F.get(kinds, e) - F.coalesce(F.get(kinds, z), F.lit(0))).alias("kind"),
                )

            def judged(now: Column) -> Column:
                limit = F.when(part(now["kind"], 0) == WINDOW, most_weight(HEX_BITS)).otherwise(most_weight(MIXED_BITS))
                hit = (
                    (i >= WINDOW - 1)
                    & (now["sum"] <= limit)
                    & (part(now["kind"], 1) > 0)
                    & (part(now["kind"], 2) > 0)
                    & ~(is_path & (part(now["kind"], 3) > 0))
                )
                at = i - (WINDOW - 1)
                return _let(
                    hit,
                    lambda h: F.struct(
                        now["n"].alias("n"),
                        now["sum"].alias("sum"),
                        now["kind"].alias("kind"),
                        F.when(h & (state["first"] < 0), at).otherwise(state["first"]).alias("first"),
                        F.when(h, at).otherwise(state["last"]).alias("last"),
                    ),
                )

            return _let(F.struct(enters.alias("e"), leaves.alias("z")), lambda x: _let(moved(x), judged))

        start = F.struct(
            F.array(*[F.lit(0).cast("long")] * longs).alias("n"), F.lit(0).alias("sum"), F.lit(0).alias("kind"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))
        )

    symbols = F.filter(F.split(text, "", -1), lambda c: c != "")
    return _let(F.transform(symbols, lambda c: F.instr(F.lit(ALPHABET), c) - 1), scan)


def secret_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED
) -> DataFrame:
    """Spans of secrets in each text, as array of (start, kind, end) in code points,
    end exclusive; kind counts :data:`KINDS`.

    Assignments of 12 or more characters to a password, secret, token or API key;
    access key ids; hexadecimal runs of 16 or more; and parts of candidate strings
    (20 or more characters of a base-64 alphabet) where a sliding window of 20
    characters has at least ``HEX_BITS`` (windows of hexadecimal digits) or
    ``MIXED_BITS`` bits a character (others). Running counts give each window from the
    one before. A candidate that matches one of ``allowed`` gives nothing, windows of
    words, numbers and directories of a path neither (:func:`_entropy_range`), and so
    does a part that lies within another span. The work grows with the length of the
    text, whatever it holds. Returns (doc_id, spans), one row per row; null and empty
    texts have no spans, repeated rows and null ids stay, other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    found = base.select(
        "doc_id",
        "text",
        *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()],
    )
    parted = found.select(
        "*",
        *[F.when(F.size(k) > 0, F.split("text", p, -1)).alias(f"{k}_gaps") for k, p in patterns.items()],
        F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("values"),
    )
    placed = parted.select("doc_id", "values", "entropy", *[_spans(F.col(k), F.col(f"{k}_gaps"), i).alias(f"{k}_at") for i, k in enumerate(patterns)])
    long_enough = F.when(
        F.size("values") > 0, F.filter("assign_at", lambda _, i: F.length(F.get("values", i)) >= 12)
    ).otherwise(F.col("assign_at"))
    open_ = lambda s: ~reduce(lambda a, b: a | b, [s.rlike(p) for p in allowed], F.lit(False))
    ranged = placed.select(
        "doc_id",
        F.concat(long_enough, "access_at", "hex_at").alias("known"),
        F.zip_with(
            "entropy",
            "entropy_at",
            lambda s, x: F.struct(x["start"].alias("at"), F.when(open_(s), _let(s.rlike(PATH), lambda path: _entropy_range(s, path))).alias("r")),
        ).alias("ranges"),
    )
    extra = F.transform(
        F.filter("ranges", lambda c: c["r"]["first"] >= 0),
        lambda c: F.struct(
            (c["at"] + c["r"]["first"]).alias("start"), F.lit(3).alias("kind"), (c["at"] + c["r"]["last"] + WINDOW).alias("end")
        ),
    )
    ordered = ranged.select("doc_id", F.sort_array(F.concat("known", extra)).alias("spans"))
    # a span that reaches as far as a window's and starts no later comes before it
    reach = _before(F.transform("spans", lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return ordered.select(
        "doc_id",
        F.when(
            F.exists("spans", lambda s: s["kind"] == 3),
            _let(reach, lambda r: F.filter("spans", lambda s, i: (s["kind"] < 3) | (F.get(r, i) < s["end"]))),
        ).otherwise(F.col("spans")).alias("spans"),
    )


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
