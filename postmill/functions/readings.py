"""Numbers of a folded text and what they measure: each is read by the words beside it, from one table of cues and units.

A text is cut at its numbers once. A number knows the text before it (up to the number before), the text behind it, and its
neighbours; every rule looks at these alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import text as T

#: Digits with groups or decimals.
NUMBER = r"\d+(?:[.,]\d+)*"
GROUPED = r"\d{1,3}(?:[.,]\d{3})+|\d{4,6}"

#: Fixed values of the original: attribute, words before, units behind, digits, factor. The first number that fits is read.
READINGS = (
    ("ram_gb", ("ram",), (), r"\d{1,3}", 1),
    ("ssd_gb", ("ssd",), ("tb",), r"\d{1,4}", 1024),
    ("ssd_gb", ("ssd",), (), r"\d{1,4}", 1),
    ("storage_gb", (), ("gb", "g"), "64|128|256|512", 1),
    ("storage_gb", (), ("",), "128|256|512", 1),
    ("storage_gb", (), ("tb",), "1", 1024),
    ("battery_pct", ("pin", "battery"), (), r"[5-9]\d|100", 1),
    ("screen_in", (), ("inch", "in", '"'), "13|14|15|16", 1),
    ("odo_km", ("odo",), (), GROUPED, 1),
    ("odo_km", (), ("km",), GROUPED, 1),
    ("odo_km", (), ("k km", "nghin km", "ngan km"), r"\d{1,3}", 1000),
    ("odo_km", ("odo",), ("k",), r"\d{1,3}", 1000),
    ("seats", (), ("cho", "seat", "seats"), r"\d{1,2}", 1),
)
MARKETS = ("vn", "ll", "zd", "za", "j", "ch", "kh")
CHIPS, CHIP_KINDS, CHIP_SHORT = "12345", ("pro", "max", "ultra"), {"p": "pro", "m": "max"}
MODEL_YEAR, EXPIRY, UNTIL = ("nam sx", "sx", "doi", "model"), ("dang kiem", "dk", "dang ky het", "han", "het han", "bao hiem", "bh"), ("den", "toi")
NO_YEAR_UNITS, DRIVEN, EXPIRY_WINDOW, DRIVEN_WINDOW = ("tr", "k", "km", "cc", "m"), ("odo", "di", "chay"), 16, 15


def numbers(x: Column) -> Column:
    """(n, left, right, prev, next, beyond, before) of each number: its text, what stands up to the neighbours, these, what stands behind the next, and the last characters before across the number before."""
    cut = F.struct(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)).alias("found"), F.split(x, NUMBER, -1).alias("between"))

    def each(c: Column) -> Column:
        found, between = c["found"], c["between"]

        def at(i: Column) -> Column:
            # three numbers back, as many as a date has
            near = F.concat(*[F.coalesce(F.get(t, i - k), F.lit("")) for k in (3, 2, 1) for t in (between, found)], F.get(between, i))
            return F.struct(
                F.get(found, i).alias("n"), F.get(between, i).alias("left"), F.get(between, i + 1).alias("right"), F.get(found, i - 1).alias("prev"), F.get(found, i + 1).alias("next"),
                F.get(between, i + 2).alias("beyond"), F.get(between, i - 1).alias("far"), F.substring(near, -EXPIRY_WINDOW, EXPIRY_WINDOW).alias("before"),
            )

        return F.transform(F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>")), at)

    # the text is cut once, not again for every number
    return T.once(cut, each)


def ends_with(text: Column, words: tuple[str, ...], gap: str = r"\s*[:.]?\s*") -> Column:
    return text.rlike(rf"(?:^|[^a-z0-9_])(?:{'|'.join(words)}){gap}$")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(rf"(?:^|[^a-z])(?:{'|'.join(words)})(?![a-z])")


def begins_with(text: Column, units: tuple[str, ...]) -> Column:
    """Whether a unit stands first, as a whole word; the unit "" means that the number stands alone."""
    one = lambda u: text.rlike(r"^(?![a-z0-9_./,])") if u == "" else text.rlike(rf"^\s*{u}") if not u.isalnum() and " " not in u else text.rlike(rf"^\s*{u.replace(' ', r'\s*')}(?![a-z0-9_])")
    return reduce(lambda a, b: a | b, map(one, units))


def _pairs(seen: Column) -> Column:
    """"16/512": memory and disk; the disk has at least 64 GB or is told in TB."""
    size = lambda p: p["next"].cast("double") * F.when(begins_with(p["beyond"], ("tb",)), 1024).otherwise(1)
    both = F.filter(seen, lambda p: p["right"].rlike(r"^\s*/\s*$") & p["n"].rlike(r"^\d{1,3}$") & p["next"].rlike(r"^\d{1,4}$") & ~p["left"].rlike("[a-z0-9_]$") & (p["beyond"].rlike(r"^\s*(?:gb|g|tb)(?![a-z0-9])") | p["beyond"].rlike(r"^(?!\s*[a-z0-9])|^\s")))
    return F.filter(F.transform(both, lambda p: F.struct(p["n"].alias("ram"), size(p).alias("ssd"), begins_with(p["beyond"], ("tb",)).alias("tb"))), lambda p: p["tb"] | (p["ssd"] >= 64))


def years(seen: Column) -> Column:
    """Model years, those behind a word for it first. A year behind a word of expiry is none, nor is one that is part of a longer number."""
    year = F.filter(seen, lambda p: p["n"].rlike(r"^(?:19|20)\d\d$") & ~holds(p["before"], EXPIRY) & ~p["before"].rlike(rf"\d\s*(?:{'|'.join(UNTIL)})\s*$"))
    named = lambda p: ends_with(p["left"], MODEL_YEAR)
    lone_digit = lambda p: p["prev"].rlike(r"^\d$") & p["far"].rlike("[a-z]$")  # noqa: E731  a model such as cx5
    joined = lambda p: (p["prev"].isNotNull() & p["left"].rlike("^[ .-]$") & ~lone_digit(p)) | (p["next"].isNotNull() & p["right"].rlike("^[ .-]$"))
    bare = lambda p: ~named(p) & ~joined(p) & ~begins_with(p["right"], NO_YEAR_UNITS)
    return T.once(year, lambda y: F.transform(F.concat(F.filter(y, named), F.filter(y, bare)), lambda p: p["n"]))


def tens_of_thousands(seen: Column) -> Column:
    """Kilometres told in tens of thousands: "5,2 van", "8 van 5"; "8v" only by a word for driving or before km."""
    digit = lambda p: F.when(p["next"].rlike(r"^\d$") & p["right"].rlike(r"^\s*v(?:an)?\s*$"), p["next"])
    behind = lambda p: F.when(digit(p).isNotNull(), p["beyond"]).otherwise(F.regexp_replace(p["right"], r"^\s*v(?:an)?", ""))
    counted = F.filter(seen, lambda p: p["n"].rlike(r"^\d{1,3}(?:[.,]\d)?$") & p["right"].rlike(r"^\s*v(?:an)?(?![a-z_])") & ~behind(p).rlike("^[a-z0-9_]"))
    sure = lambda p: p["right"].rlike(r"^\s*van") | holds(F.substring(p["before"], -DRIVEN_WINDOW, DRIVEN_WINDOW), DRIVEN) | begins_with(behind(p), ("km",))
    value = lambda p: F.regexp_extract(p["n"], r"^\d+", 0).cast("double") * 10_000 + F.coalesce(F.nullif(F.regexp_extract(p["n"], r"[.,](\d)$", 1), F.lit("")), digit(p), F.lit("0")).cast("double") * 1000
    return F.transform(F.filter(counted, sure), value)


def shown(n: Column) -> Column:
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))


def _read(seen: Column, cues: tuple[str, ...], units: tuple[str, ...], digits: str, factor: int) -> Column:
    """The first number that fits a row of the table, or null."""

    def fits(p: Column) -> Column:
        ok = p["n"].rlike(f"^(?:{digits})$")
        ok = ok & ends_with(p["left"], cues) if cues else ok & ~p["left"].rlike(r"[/]$")
        return ok & begins_with(p["right"], units) if units else ok

    whole = F.regexp_replace(F.get(F.filter(seen, fits), F.lit(0))["n"], "[.,]", "")
    return whole if factor == 1 else T.once(whole.cast("double") * factor, shown)


def readings(x: Column) -> Column:
    """(key, raw) of all that the numbers of a folded text tell, in order of preference within a key."""
    return F.get(F.transform(F.array(numbers(x)), lambda seen: _all(x, seen)), F.lit(0))


def _all(x: Column, seen: Column) -> Column:
    some = lambda key, c: F.transform(F.array_compact(F.array(c)), lambda v: F.struct(F.lit(key).alias("key"), v.alias("raw")))
    every = lambda key, c: F.transform(c, lambda v: F.struct(F.lit(key).alias("key"), v.alias("raw")))
    chip = F.get(F.filter(seen, lambda p: F.lit(CHIPS).contains(p["n"]) & (F.length(p["n"]) == 1) & p["left"].rlike("(?:^|[^a-z0-9_])m$") & p["right"].rlike(rf"^(?:\s*(?:{'|'.join(CHIP_KINDS)})(?![a-z0-9_])|[{''.join(CHIP_SHORT)}]?(?![a-z0-9_]))")), F.lit(0))

    def chips(c: Column) -> Column:
        name = F.concat(F.lit("m"), c["n"])
        kind = F.nullif(F.regexp_extract(c["right"], rf"^\s*({'|'.join(CHIP_KINDS)})(?![a-z0-9_])", 1), F.lit(""))
        short = F.regexp_extract(c["right"], rf"^([{''.join(CHIP_SHORT)}])(?![a-z0-9_])", 1)
        long = reduce(lambda a, s: F.when(short == s, CHIP_SHORT[s]).otherwise(a), CHIP_SHORT, F.lit(None).cast("string"))
        return F.concat(some("chip", F.concat(name, F.lit("_"), F.coalesce(kind, long))), some("chip", name))

    table = [some(key, _read(seen, *rule)) for key, *rule in READINGS]
    markets = F.filter(F.regexp_extract_all(x, F.lit(r"(?<![a-z0-9_])([a-z]+) ?/ ?a(?![a-z0-9_])"), F.lit(1)), lambda m: m.isin(*MARKETS))
    return F.concat(
        T.once(chip, chips),
        T.once(_pairs(seen), lambda pairs: F.concat(every("ram_gb", F.transform(pairs, lambda p: p["ram"])), every("ssd_gb", F.transform(pairs, lambda p: shown(p["ssd"]))))),
        every("year", years(seen)), every("odo_km", F.transform(tens_of_thousands(seen), shown)), *table, every("market", markets),
    )
