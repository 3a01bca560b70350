"""Text and array functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SPACES = r"(?U)[\s\x1c-\x1f]+"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(text: Column) -> Column:
    """Without white space (Unicode's and the ASCII separators) at both ends."""
    return F.regexp_replace(text, _EDGE, "")


def collapse(text: Column) -> Column:
    """Stripped, runs of white space being one space."""
    return F.regexp_replace(strip(text), _SPACES, " ")


def lines(text: Column) -> Column:
    return F.split(text, _LINE_END)


def paragraphs(text: Column) -> Column:
    """Stripped parts between blank lines, without empty ones; null text has none."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def key_id(*parts: Column) -> Column:
    """A deterministic id of its parts, so that retried tasks agree. Each part is hashed with its length, and null as ``-``, so
    that no other parts have the same id."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often, and in whatever inner function, it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lengths: Column, block: int = 64) -> Column:
    """For each position of an array the sum of what stands before it, by blocks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    at = lambda i: F.floor(i / block).cast("int")

    def sums(own: Column) -> Column:
        last = F.greatest(F.ceil(F.size(own) / block).cast("int"), F.lit(1)) - 1
        each = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(own, b * block + 1, F.lit(block))))
        state = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("out"))
        before = F.aggregate(each, state, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))["out"]
        return let(before, lambda b: F.transform(own, lambda _, i: F.get(b, at(i)) + total(F.slice(own, at(i) * block + 1, i % block))))

    return let(lengths, sums)


def at_or_before(places: Column, starts: Column) -> Column:
    """For each of ``places`` how many of ``starts`` are no greater; both are arrays of longs in ascending order. They are merged once,
    so the work is linear in the two together."""
    merged = F.sort_array(F.concat(F.transform(starts, lambda s: s * 2), F.transform(places, lambda p: p * 2 + 1)))
    own = F.filter(F.transform(merged, lambda x, at: F.when(x % 2 == 1, at)), lambda at: at.isNotNull())
    return F.transform(own, lambda at, i: at - i)


def tallies(codes: Column, n: int) -> Column:
    """How often each number from 0 to ``n`` - 1 is in the array ``codes``: between the marks of a sorted array, without a shuffle."""
    marks = F.sequence(F.lit(0), F.lit(2 * n), F.lit(2))
    merged = F.sort_array(F.concat(F.transform(codes, lambda c: c * 2 + 1), marks))
    at = F.filter(F.transform(merged, lambda x, i: F.when(x % 2 == 0, i)), lambda i: i.isNotNull())
    return let(at, lambda a: F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: y - x - 1))
