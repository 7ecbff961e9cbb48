"""The feature catalogue: 39 columns in five groups, made block by block."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blocks import BLOCK_ROWS, halo, map_blocks, positions, several
from tidemark.functions.rolling import divide, expanding_z_columns, pct, rolling, rolling_corr, shift, since_first_max
from tidemark.functions.windows import Ent, col, whole

YEAR, ROOT = 252, 252**0.5


def prefer_column(df: DataFrame, candidates: list[str], ent: Ent, out: str) -> DataFrame:
    """Per entity the first candidate that exists and has any value; not a row-wise coalesce."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        return df.withColumn(out, F.lit(None).cast("double"))
    pick = reduce(lambda w, c: w.when(F.count(c).over(whole(ent)) > 0, F.col(c)), there, F)
    return df.withColumn(out, pick)


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


@dataclass(frozen=True)
class Group:
    """A group of features: `local` makes columns from a block's columns, `z` standardises some of these by all that came before.

    `columns` are what `local` reads ("_px" is the price), `before` the rows ahead of a block that it needs.
    """

    columns: tuple[str, ...]
    before: int
    local: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
    z: dict[str, str]
    out: list[str]


def _math(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Volatility, shape, drawdown and memory of returns."""
    px, r = x["_px"], pct(x["_px"], 1)
    v21, std63 = rolling(r, "std", 21) * ROOT, rolling(r, "std", 63)
    acf = lambda n, k: np.where(~np.isnan(rolling(r, "mean", n)), rolling_corr(r, shift(r, k), n - k), np.nan)
    side = lambda keep: rolling(np.where(keep, r, np.nan), "std", 63, 15)
    return {
        "_v21": v21, "_v63": std63 * ROOT, "_v252": rolling(r, "std", YEAR) * ROOT, "_atr": rolling(np.abs(r), "mean", 21), "skew_63": rolling(r, "skew", 63), "kurt_63": rolling(r, "kurt", 63),
        "dd_from_252h": (divide(px, rolling(px, "max", YEAR)) - 1) * 100, "days_since_252h": since_first_max(px, YEAR), "acf_10": acf(63, 10), "acf_20": acf(126, 20),
        "iv_rv_gap": x["vix_close"] / 100 - v21, "return_dispersion_63": std63, "downside_vol_ratio_63": divide(side(r < 0), side(r > 0)),
    }


MATH = ["rv_21_z", "rv_63_z", "rv_252_z", "skew_63", "kurt_63", "dd_from_252h", "days_since_252h", "acf_10", "acf_20", "range_atr_z", "iv_rv_gap",
        "return_dispersion_63", "downside_vol_ratio_63"]


def _macro(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Curve, credit, conditions, labour, money and valuation."""
    change = lambda c: x[c] - shift(x[c], 20)
    ue = rolling(x["unemployment_rate"], "mean", 63)
    real = x["yield_10y"] - pct(x["cpi"], YEAR) * 100
    return {
        "yc_10y_3m": x["yield_10y_3m"], "yc_10y_2y": x["yield_10y_2y"], "yc_10y_3m_chg": change("yield_10y_3m"), "hy_spread_chg": change("_hy"), "nfci_level": x["_nfci"], "nfci_chg": change("_nfci"),
        "nfci_leverage_level": x["nfci_leverage"], "nfci_credit_level": x["nfci_credit"], "sahm_indicator": ue - rolling(ue, "min", YEAR), "real_rate_10y": np.where(x["_has_dfii10"] == 1, x["dfii10"], real),
        "_hy": x["_hy"], "_ig": x["_ig"], "_stlfsi": x["stlfsi"], "_epu": x["epu"], "_claims": pct(x["initial_claims"], 65),
        "_cape": divide(x["_px"], rolling(x["_px"], "mean", 2520, 1260)), "_m2": pct(x["m2_money_supply"], YEAR),
    }


MACRO = ["yc_10y_3m", "yc_10y_2y", "yc_10y_3m_chg", "hy_spread_z", "hy_spread_chg", "ig_spread_z", "nfci_level", "nfci_chg", "nfci_leverage_level", "nfci_credit_level",
         "stlfsi_z", "epu_z", "sahm_indicator", "claims_13w_chg_z", "cape_proxy_z", "m2_yoy_z", "real_rate_10y"]


def _options(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"_vix": x["vix_close"], "_jump": pct(x["vix_close"], 5), "vix_term_structure": divide(x["vix_close"], x["vxv_close"])}


OPTIONS = ["vix_z", "vix_shock_5d", "vix_term_structure"]


def _breadth(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moving averages, and the correlation of price with bonds, which change in percent where they are positive throughout."""
    px, bond = x["_px"], x["_bond"]
    ma50, ma200 = rolling(px, "mean", 50), rolling(px, "mean", 200)
    moves = np.where(x["_positive"] == 1, pct(bond, 1), bond - shift(bond, 1))
    return {
        "ma50_dist": (divide(px, ma50) - 1) * 100, "ma200_dist": (divide(px, ma200) - 1) * 100, "ma50_above_ma200": (ma50 > ma200).astype(float),
        "_corr": rolling_corr(pct(px, 1), moves, 63), "_dxy": x["dollar_twi"],
    }


BREADTH = ["ma50_dist", "ma200_dist", "ma50_above_ma200", "cross_asset_corr_z", "dxy_z"]

GROUPS = {
    "math": Group(("_px", "vix_close"), YEAR + 1, _math, {"rv_21_z": "_v21", "rv_63_z": "_v63", "rv_252_z": "_v252", "range_atr_z": "_atr"}, MATH),
    "macro": Group(
        ("_px", "_hy", "_ig", "_nfci", "_has_dfii10", "yield_10y_3m", "yield_10y_2y", "nfci_leverage", "nfci_credit", "stlfsi", "epu", "unemployment_rate", "initial_claims", "m2_money_supply", "dfii10", "yield_10y", "cpi"),
        2520, _macro, {"hy_spread_z": "_hy", "ig_spread_z": "_ig", "stlfsi_z": "_stlfsi", "epu_z": "_epu", "claims_13w_chg_z": "_claims", "cape_proxy_z": "_cape", "m2_yoy_z": "_m2"}, MACRO),
    "options": Group(("vix_close", "vxv_close"), 5, _options, {"vix_z": "_vix", "vix_shock_5d": "_jump"}, OPTIONS),
    "breadth": Group(("_px", "_bond", "_positive", "dollar_twi"), 200, _breadth, {"cross_asset_corr_z": "_corr", "dxy_z": "_dxy"}, BREADTH),
    "geo": Group(("oil_wti",), 21, lambda x: {"_oil": pct(x["oil_wti"], 21)}, {"oil_shock_z": "_oil"}, ["oil_shock_z"]),
}
FEATURES = [c.removesuffix("_level") for c in MATH + MACRO + OPTIONS + BREADTH] + ["oil_shock_z"]
#: Candidates of which an entity takes the first that has any value.
PREFERRED = {"_hy": ["hy_spread", "baa_10y_spread"], "_ig": ["aaa_10y_spread", "baa_10y_spread", "credit_spread_bbb"], "_nfci": ["nfci", "anfci", "kcfsi"]}


def _inputs(df: DataFrame, needs: set[str], px: str | None, ent: Ent) -> DataFrame:
    """`df` with the columns that the groups read as doubles `_in_<name>`; what holds for a whole entity comes from one aggregate."""
    bond = F.col("v6_tlt").cast("double") if "v6_tlt" in df.columns else -_or_null(df, "yield_10y")
    has = {c: F.count(c) for c in sorted({c for n, cs in PREFERRED.items() if n in needs for c in cs} | ({"dfii10"} & needs)) if c in df.columns}
    facts = {f"_n_{c}": e for c, e in has.items()} | ({"_all_positive": F.every(F.coalesce(bond > 0, F.lit(False)))} if "_positive" in needs else {})
    own = {"_px": F.col(px).cast("double") if px else None, "_bond": bond}
    for name, candidates in PREFERRED.items():
        there = [c for c in candidates if c in has]
        own[name] = reduce(lambda w, c: w.when(F.col(f"_n_{c}") > 0, F.col(c).cast("double")), there, F) if there else F.lit(None).cast("double")
    own["_has_dfii10"] = (F.col("_n_dfii10") > 0).cast("double") if "dfii10" in has else F.lit(0.0)
    own["_positive"] = F.col("_all_positive").cast("double") if "_positive" in needs else None
    if facts:
        known = df.groupBy(*ent).agg(*[e.alias(n) for n, e in facts.items()]).select(*facts, *[F.col(c).alias(f"_e{i}") for i, c in enumerate(ent)])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(ent)], F.lit(True))
        df = df.join(known, same)
    return df.withColumns({f"_in_{c}": own[c] if c in own else _or_null(df, c) for c in sorted(needs)})


def features(df: DataFrame, groups: Sequence[str], ent: Ent, t: str, px: str | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` with the features of `groups`. Blocks with halo rows make what looks back a bounded number of rows; what looks back
    to the start joins sums of the blocks before. Neither cost per row nor the length of a task's input grows with the entity."""
    used = [GROUPS[g] for g in groups]
    needs = {c for g in used for c in g.columns}
    z = {out: c for g in used for out, c in g.z.items()}
    kept = [c for g in used for c in g.out if c not in z]
    wide = _inputs(df, needs, px, ent)
    read = [f"_in_{c}" for c in sorted(needs)]

    def local(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        named = {c.removeprefix("_in_"): v for c, v in x.items()}
        made = {c: v for g in used for c, v in g.local(named).items()}
        return {c: made[c] for c in kept} | {f"_z_{out}": made[c] for out, c in z.items()}

    placed = positions(wide.select(*df.columns, *read), ent, t)
    cur = map_blocks(halo(placed, rows, max(g.before for g in used)), ent, read, local, [*kept, *(f"_z_{c}" for c in z)], keep=["_pos", "_block"])
    done = expanding_z_columns(cur.drop(*read), {c: f"_z_{c}" for c in z}, ent, several(placed, rows))
    return done.select(*df.columns, *[c for g in used for c in g.out])


def features_math(df: DataFrame, px: str, ent: Ent, t: str, rows: int = BLOCK_ROWS) -> DataFrame:
    return features(df, ["math"], ent, t, px, rows)


def features_macro(df: DataFrame, px: str, ent: Ent, t: str, rows: int = BLOCK_ROWS) -> DataFrame:
    return features(df, ["macro"], ent, t, px, rows)


def features_options(df: DataFrame, ent: Ent, t: str, rows: int = BLOCK_ROWS) -> DataFrame:
    return features(df, ["options"], ent, t, None, rows)


def features_breadth(df: DataFrame, px: str, ent: Ent, t: str, rows: int = BLOCK_ROWS) -> DataFrame:
    return features(df, ["breadth"], ent, t, px, rows)


def features_geo(df: DataFrame, ent: Ent, t: str, rows: int = BLOCK_ROWS) -> DataFrame:
    return features(df, ["geo"], ent, t, None, rows)


def build_features(df: DataFrame, ent: Ent, t: str, px: str = "sp500_close", rows: int = BLOCK_ROWS) -> DataFrame:
    """Keys, price and the 39 features, made in one pass over blocks."""
    out = features(df, list(GROUPS), ent, t, px, rows)
    made = {c: F.col(f"{c}_level" if f"{c}_level" in out.columns else c) for c in FEATURES}
    return out.select(*ent, t, F.col(px).alias("_price"), *[e.alias(c) for c, e in made.items()])


def feature_coverage(df: DataFrame, columns: list[str], t: str) -> DataFrame:
    """Per column: n_obs, first_valid, pct of rows (1 decimal), sparsest first."""
    long = df.select(t, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(t, "x.*")
    return long.groupBy("feature").agg(
        F.count("v").alias("n_obs"), F.min(F.when(F.col("v").isNotNull(), F.col(t))).alias("first_valid"),
        F.round(F.count("v") * 100.0 / F.count(F.lit(1)), 1).alias("pct"),
    ).orderBy("pct", "feature")
