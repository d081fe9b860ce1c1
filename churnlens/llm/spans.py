"""Spans of pattern matches in whole texts, with DataFrame functions only.

A pattern cuts a text into the pieces between its matches, and the lengths of
pieces and matches, added up, give the places in code points. The running
total goes over blocks of ``BLOCK`` matches, so that a text with very many
matches takes time in proportion to them. Patterns must be possessive where
they repeat a group: then the regex engine neither recurses nor backtracks on
very long texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
LEFT, RIGHT = 40, 12
SPAN = "struct<start:int,end:int,value:string,left:string,right:string>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, and which matches count (a function of the match and group 1's array)."""

    name: str
    pattern: str
    group: int = 0
    keep: object = None  # (Column match, Column group) -> Column boolean


def _running(steps: Column) -> Column:
    """Exclusive running totals of an int array."""
    def scan(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct(
            (a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    block = lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x))
    bases = scan(sums, F.lit(0))
    return F.flatten(F.transform(blocks, lambda b: scan(block(b), F.get(bases, b))))


def _spans(k: Kind) -> Column:
    pieces, matches, starts = F.col(f"_p_{k.name}"), F.col(f"_m_{k.name}"), F.col(f"_s_{k.name}")

    def span(m: Column, i: Column) -> Column:
        before = F.get(pieces, i)
        start = F.get(starts, i) + F.length(before)
        good = k.keep(m, F.get(F.col(f"_g_{k.name}"), i) if k.group else m) if k.keep is not None else F.lit(True)
        return F.when(good, F.struct(
            start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("end"), m.alias("value"),
            F.substring(before, F.greatest(F.length(before) - LEFT + 1, F.lit(1)), F.lit(LEFT)).alias("left"),
            F.substring(F.get(pieces, i + 1), 1, RIGHT).alias("right")))
    return F.filter(F.transform(matches, span), lambda s: s.isNotNull())


def add_spans(df, text: str, kinds: list[Kind], to: str = "_spans_"):
    """Add ``{to}{kind}`` for each kind: array of SPAN in order; null text gives empty arrays.

    Works in layers of columns, so that each regex runs once per row.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({f"_m_{k.name}": F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(0)) for k in kinds})
    hit = {k.name: F.size(f"_m_{k.name}") > 0 for k in kinds}
    df = df.withColumns(
        {f"_p_{k.name}": F.when(hit[k.name], F.split(whole, k.pattern, -1)) for k in kinds}
        | {f"_g_{k.name}": F.when(hit[k.name], F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(k.group)))
           for k in kinds if k.group})
    df = df.withColumns({f"_s_{k.name}": F.when(hit[k.name], _running(
        F.zip_with(f"_p_{k.name}", f"_m_{k.name}", lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))))
        for k in kinds})
    out = {f"{to}{k.name}": F.coalesce(F.when(hit[k.name], _spans(k)), F.array().cast(f"array<{SPAN}>")) for k in kinds}
    temporary = [f"_{x}_{k.name}" for k in kinds for x in ("m", "p", "g", "s")]
    return df.withColumns(out).drop(*temporary)


def labelled(kinds: list[str], to: str = "_spans_") -> Column:
    """All spans of the kinds as array<struct<start, no, end, kind>>, in order of start, then of the list."""
    def of(n: int, kind: str) -> Column:
        return F.transform(F.col(f"{to}{kind}"), lambda s: F.struct(
            s["start"].alias("start"), F.lit(n).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.sort_array(F.concat(*[of(n, kind) for n, kind in enumerate(kinds)]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, kind: Kind, mark: str) -> Column:
    """The text with each counted match of the kind replaced by ``mark``."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else matches
    both = F.zip_with(matches, groups, lambda m, g: (F.when(kind.keep(m, g), F.lit(mark)).otherwise(m)
                                                     if kind.keep is not None else F.lit(mark)))
    pieces = F.split(text, kind.pattern, -1)
    return F.array_join(F.zip_with(pieces, both, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
