"""Which few settings fix the most rows: coverage edges, greedy cover, exact cover of a small remainder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled


def coverage_edges(base: DataFrame, masked: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """(unit, head): head lowers the unit's count; only heads that help one, harm none and did not fail the regression check.

    base: unit, base_count.  masked: head, unit, count (units that are missing are skipped).  checked: head, regression_ok (null: unchecked).
    """
    both = masked.join(base, "unit")
    ok = both.groupBy("head").agg(F.bool_and(F.col("count") <= F.col("base_count")).alias("harmless"), F.bool_or(F.col("count") < F.col("base_count")).alias("helps"))
    ok = ok.where("harmless AND helps")
    if checked is not None:
        ok = ok.join(checked.where("regression_ok = false").select("head"), "head", "left_anti")
    return both.where((F.col("base_count") > 0) & (F.col("count") < F.col("base_count"))).join(ok.select("head"), "head").select("unit", "head")


def greedy_cover(edges: DataFrame, most: int | None = None) -> list[tuple[int, int]]:
    """(head, newly covered units) in order: each time the head that covers most of what is left, the lowest of equal ones, until
    every unit of an edge is covered.  most: if it is given and does not do, an error says how many units are left.

    Units with the same heads are one row with their number; these rows stay distributed, and each round counts heads and
    drops the rows of the head picked.
    """
    picked: list[tuple[int, int]] = []
    left = settled(unit_signatures(edges.where("unit IS NOT NULL AND head IS NOT NULL")))
    while True:
        best = left.select(F.explode("heads").alias("head"), "units").groupBy("head").agg(F.sum("units").alias("n")).orderBy(F.desc("n"), "head").first()
        if best is None:
            return picked
        if most is not None and len(picked) >= most:
            raise ValueError(f"{most} heads leave {left.agg(F.sum('units')).first()[0]} units uncovered")
        picked.append((best["head"], best["n"]))
        left = left.where(~F.array_contains("heads", best["head"]))
        if len(picked) % 32 == 0:  # what is left is written anew, so that no round filters by all picks
            left = settled(left)


def exact_cover_size(signatures: list[frozenset], heads: int) -> int:
    """The fewest heads that meet every signature (the distinct sets of heads that cover a unit), by branch and bound."""
    need = sorted({s for s in signatures if s and not any(o < s for o in signatures if o)}, key=lambda s: (len(s), sorted(s)))
    best = [heads + 1]

    def search(left: list[frozenset], used: int) -> None:
        if used >= best[0]:
            return
        if not left:
            best[0] = used
            return
        if used + 1 >= best[0]:
            return
        for head in sorted(left[0], key=lambda h: (-sum(h in s for s in left), h)):
            search([s for s in left if head not in s], used + 1)

    search(need, 0)
    return best[0] if need else 0


def unit_signatures(edges: DataFrame) -> DataFrame:
    """The distinct sets of heads, with how many units have each: as many rows as patterns, whatever the number of units."""
    return edges.groupBy("unit").agg(F.sort_array(F.collect_set("head")).alias("heads")).groupBy("heads").agg(F.count("*").alias("units"))
