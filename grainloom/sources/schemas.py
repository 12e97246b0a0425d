"""Schemas and natural keys of the landing tables."""

from __future__ import annotations

_PRICE = "date date, open double, high double, low double, close double, volume double, commodity string"

#: Table: (schema, key).
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    **{t: (_PRICE, ("date",)) for t in ("raw_price_futures", "raw_crude_oil", "raw_soybean_futures", "raw_soymeal_futures", "raw_palm_oil", "raw_canola_oil")},
    "raw_exchange_rate": ("date date, usd_brl_close double, usd_brl_open double, usd_brl_high double, usd_brl_low double, is_interpolated int", ("date",)),
    "raw_price_spot": ("date date, spot_price_usd double, spot_price_brl double, source string", ("date",)),
    "raw_dollar_index": ("date date, dxy_close double, dxy_open double, dxy_high double, dxy_low double", ("date",)),
    "raw_sunflower_oil": ("date date, sunflower_close double, source string", ("date",)),
    "raw_eia_biodiesel": ("date date, soybean_oil_biofuel_mmlb double, source string", ("date",)),
    "raw_fed_rate": ("date date, fed_rate double, source string", ("date",)),
    "raw_vix": ("date date, vix_close double, source string", ("date",)),
    "raw_cftc": ("report_date date, release_date date, noncomm_long double, noncomm_short double, noncomm_net double", ("release_date",)),
    "raw_wasde": (
        "release_date date, marketing_year string, wasde_soyoil_stock_to_use double, wasde_soy_prod_brazil double, wasde_world_production double, is_wasde_release_day int",
        ("release_date", "marketing_year"),
    ),
    "raw_news_scored": ("date date, title string, url string, source string, category string, sentiment_score double, impact_score double, certainty_factor double, weight double, final_score double", ("url",)),
    "raw_sap_inventory": ("date date, inventory_ton double, safety_stock_ton double, tank_capacity_ton double, warehouse_code string", ("date",)),
    "raw_sap_po_history": ("po_number string, po_date date, delivery_date date, quantity_ton double, unit_price double, contract_type string, supplier_code string", ("po_number",)),
    "raw_sap_production": ("plan_date date, production_quantity_ton double, product_code string, plant_code string", ("plan_date", "product_code", "plant_code")),
}
