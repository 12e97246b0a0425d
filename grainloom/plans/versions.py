"""Named feature sets, columns in the order that saved models expect."""

from __future__ import annotations

# Column names of the sets, in order, as runs that sets share.
LEVEL = ("price_close", "price_lag_1", "price_lag_3", "price_lag_7", "price_lag_14", "price_lag_30", "price_ma_7", "price_ma_14", "price_ma_30")
PRICE = ("price_to_ma7_ratio", "price_to_ma14_ratio", "price_to_ma30_ratio", "return_1d", "return_3d", "return_7d", "return_14d", "volatility_5d", "volatility_10d", "volatility_20d")
EXCHANGE = ("usd_brl_lag_1", "usd_brl_return_7d", "usd_brl_volatility_14d")
CRUDE = ("wti_lag_1", "wti_return_7d", "wti_volatility_14d")
CRUSH = ("crush_spread", "crush_spread_ma7", "crush_spread_lag_1")
POSITIONS = ("cftc_noncomm_net", "cftc_noncomm_net_chg_1w", "cftc_long_short_ratio")
SUPPLY = ("wasde_soyoil_stock_to_use", "wasde_soy_prod_brazil", "wasde_world_production")
SEASON = ("month", "week_of_year", "quarter", "is_planting_season", "is_flowering_season", "is_harvest_season", "days_to_next_harvest")
DOLLAR = ("dxy_close", "dxy_lag_1", "dxy_return_7d", "dxy_volatility_14d")
OILS = ("canola_close", "canola_lag_1", "canola_return_7d", "sunflower_close", "sunflower_return_30d")
BIOFUEL = ("biodiesel_production_kbbl", "biodiesel_chg_4w")
MARKET = ("market_avg_price_30d", "price_vs_market_avg")
RATE = ("fed_rate", "fed_rate_chg_1m", "fed_rate_chg_3m")
FEAR = ("vix_close", "vix_lag_1", "vix_return_7d", "vix_regime")
EVENTS = ("wasde_release_day", "is_wasde_week", "days_to_wasde", "days_since_wasde", "is_cftc_release_day", "days_to_cftc")
LABELS_7 = ("target_price_t1", "target_price_t7", "target_return_t7", "target_updown_t7")
LABELS_28 = ("target_price_t28", "target_return_t28", "target_updown_t28")
MINIMAL = ("wasde_soyoil_stock_to_use", "vix_close", "vix_lag_1", "crush_spread_ma7", "usd_brl_lag_1", "usd_brl_volatility_14d", "wti_lag_1", "cftc_percentile_52w", "canola_lag_1", "dxy_lag_1")

_DAILY = (*PRICE, *EXCHANGE, *CRUDE, *CRUSH, *POSITIONS)
_CLEAN = (*_DAILY, "cftc_percentile_52w", "wasde_soyoil_stock_to_use", "wasde_world_production", *SEASON, *DOLLAR, "canola_close", "canola_lag_1", "sunflower_close", *MARKET, *RATE, *FEAR, "momentum_accel_7d", "price_above_200d_ma", *EVENTS)
_BY_HORIZON = (*LABELS_7, "target_thresh_t7", *LABELS_28, "target_thresh_t28")

#: Columns of each version but the tag; empty versions stay empty.
VERSIONS: dict[str, tuple[str, ...]] = {
    "v1": (*LEVEL, *PRICE, "usd_brl_close", "is_interpolated", *EXCHANGE, "wti_close", *CRUDE, *CRUSH, *POSITIONS, *SUPPLY, "spot_price_usd", "basis", *SEASON, *LABELS_7),
    "v1_stationary": (*_DAILY, *SUPPLY, *SEASON, *LABELS_7),
    "v2_interview": (*_DAILY, *SUPPLY, *SEASON, *DOLLAR, *OILS, *BIOFUEL, *MARKET, *LABELS_7, *LABELS_28),
    "v2": (),
    "v3": (),
    "v3_enhanced": (*_DAILY, "cftc_percentile_52w", *SUPPLY, *SEASON, *DOLLAR, *OILS, *MARKET, "palm_soyoil_spread", *RATE, *FEAR, "momentum_accel_7d", "seasonal_adj_return_7d", "price_above_200d_ma", *EVENTS, *LABELS_7, *LABELS_28),
    "v3_clean": (*_CLEAN, *LABELS_7, *LABELS_28, "target_thresh_t7", "target_thresh_t28"),
    "v3_minimal_thresh": (*_CLEAN, *_BY_HORIZON),
    "v3_minimal": (*RATE, *MARKET, *MINIMAL, *LABELS_7, *LABELS_28, "target_thresh_t7", "target_thresh_t28"),
    "ensemble_v3_clean_t28": (*_CLEAN, *_BY_HORIZON),
}
ACTIVE = "ensemble_v3_clean_t28"


def columns(version: str = ACTIVE) -> list[str]:
    """Columns of a named set in order, the version's tag last; empty for the empty sets."""
    names = VERSIONS[version]
    return [*names, "feature_version"] if names else []
