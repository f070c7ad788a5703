"""Declared temporal bases and which columns of them a group may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clock


def temporal_basis(hours: DataFrame, kind: str = "constant") -> DataFrame:
    """Long basis ``t_idx, basis_idx, basis_name, phi`` of ``hours(t_idx, ts)``: constant, daily (constant, sine, cosine) or daytime (constant, 7-19 h)."""
    h = F.hour("ts") + F.minute("ts") / 60.0
    angle = 2 * F.pi() * h / 24.0
    kinds = {
        "constant": [("constant", F.lit(1.0))],
        "daily": [("constant", F.lit(1.0)), ("sin", F.sin(angle)), ("cos", F.cos(angle))],
        "daytime": [("constant", F.lit(1.0)), ("day", F.when((h >= 7) & (h < 19), 1.0).otherwise(0.0))],
    }
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("basis_idx"), F.lit(n).alias("basis_name"), c.alias("phi")) for i, (n, c) in enumerate(kinds[kind])])
    return hours.select("t_idx", F.explode(rows).alias("x")).select("t_idx", "x.*")


#: Components that groups declare: (name, the group that owns it).
DECLARED = (
    *((f"traffic_slot_{h:02d}", "traffic") for h in clock.SLOTS), ("kiln_block_12h", "brick_kilns"), ("industry_day_night", "industries"), ("population_cooking", "population_density"),
)


def declared_basis(hours: DataFrame) -> DataFrame:
    """Long basis ``t_idx, basis_idx, basis_name, owner, phi`` of all groups: traffic slots, kiln blocks by position, industry by day and night, cooking peaks."""
    h = F.hour("ts").cast("double")
    cooking = F.lit(0.2)
    for peak in clock.PEAKS:
        d = clock.circular_hours(h, peak) / clock.WIDTH
        cooking = cooking + 0.8 * F.exp(-0.5 * d * d)
    low, high = clock.KILN_LEVELS
    values = [
        *(F.when(clock.slot(h) == s, 1.0).otherwise(0.0) for s in clock.SLOTS), F.when(clock.block12(F.col("t_idx")), high).otherwise(low),
        F.when((h >= 7) & (h <= 19), 1.0).otherwise(0.35), F.least(cooking, F.lit(1.0)),
    ]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("basis_idx"), F.lit(n).alias("basis_name"), F.lit(o).alias("owner"), v.alias("phi")) for i, ((n, o), v) in enumerate(zip(DECLARED, values))])
    return hours.select("t_idx", F.explode(rows).alias("x")).select("t_idx", "x.*")


def admissible(groups: DataFrame) -> DataFrame:
    """``source_idx, basis_idx`` that each of ``groups(source_idx, source_name)`` may use: its own components; a group without any keeps the first."""
    own = F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(i).cast("long").alias("basis_idx")) for i, (_, o) in enumerate(DECLARED)])
    found = F.transform(F.filter(own, lambda x: x.owner == F.col("source_name")), lambda x: x.basis_idx)
    return groups.select("source_idx", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("long")))).alias("basis_idx"))


def fixed_zeros(pairs: DataFrame, forbidden: Column, n_basis: int) -> DataFrame:
    """``col_idx = source * n_basis + basis`` of the (source, basis) pairs a group may not use."""
    return pairs.where(forbidden).select((F.col("source_idx") * n_basis + F.col("basis_idx")).alias("col_idx"))
