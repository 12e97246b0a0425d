"""Buy, split or wait: procurement recommendations for any number of requests, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import latest_asof
from ..operators.chunks import align_asof_long
from ..operators.profile import require_columns, split_requests
from ..sources.writers import log_decisions

# Fixed values of the decision rules.
LEAD_DAYS, WAREHOUSE_MONTHS, MIN_ORDER_TON, SPLIT_DAYS, CBOT_TO_TON, BAND = 50, 4.0, 2000.0, 7, 22.0462, 0.03


def to_ton(c: Column, unit: Column) -> Column:
    return F.when(unit == "cbot", c * CBOT_TO_TON).otherwise(c)


def action_rule(inventory: Column, safety: Column, price: Column, p50: Column) -> tuple[Column, Column]:
    """Recommended action and the code of its reason; no action where stock, price or forecast is unknown."""
    low, up, down = inventory < safety, p50 > price * (1 + BAND), p50 < price * (1 - BAND)
    known = price.isNotNull() & p50.isNotNull() & low.isNotNull()
    action = F.when(~known, None).when(low | up, "Buy").when(down, "Wait").otherwise("Split")
    code = F.when(low, "inventory_below_safety").when(up, "expected_price_up_3pct").when(down, "expected_price_down_3pct").otherwise("expected_price_neutral_band")
    return action, F.when(known, code)


def _tons(c: Column) -> Column:
    return F.format_string("%.0f", c)


def _usd(c: Column) -> Column:
    return F.format_number(c, 0)


def _option(action: str, cost: Column, reward: Column, feasible: Column, notes: Column) -> Column:
    low, high = F.col("quantity_ton") * F.col("p10_ton"), F.col("quantity_ton") * F.col("p90_ton")
    risk = F.struct(F.bround(low, 2).alias("p10_total_usd"), F.bround(high, 2).alias("p90_total_usd"), F.bround(high - low, 2).alias("span_usd"))
    return F.struct(F.lit(action).alias("action"), F.bround(cost, 2).alias("expected_cost_usd"), risk.alias("risk"), F.bround(reward, 2).alias("reward_usd"), feasible.alias("feasible"), notes.alias("notes"))


def stock_position(df: DataFrame) -> DataFrame:
    """Effective inventory, inventory when a delivery is due, warehouse cap."""
    effective = F.col("current_inventory_ton") + F.col("open_po_ton")
    return df.withColumns({"effective_inventory_ton": effective, "inventory_at_due_ton": effective - F.col("monthly_consumption_ton") * (LEAD_DAYS / 30.0), "warehouse_cap_ton": F.col("monthly_consumption_ton") * WAREHOUSE_MONTHS})


def evaluate(requests: DataFrame) -> DataFrame:
    """Options, recommendation and texts for valid requests.

    requests: current_price_cbot, market_avg_cbot (null: unknown), decision_date, current_inventory_ton, open_po_ton,
    safety_stock_ton, quantity_ton, monthly_consumption_ton, p10, p50, p90, forecast_unit; other columns pass through.
    """
    unit = F.col("forecast_unit")
    df = stock_position(requests).withColumns({f"{q}_ton": to_ton(F.col(q), unit) for q in ("p10", "p50", "p90")} | {"current_price": F.col("current_price_cbot") * CBOT_TO_TON, "market_avg_price": F.col("market_avg_cbot") * CBOT_TO_TON, "due_date": F.date_add("decision_date", LEAD_DAYS)})
    price, p50, q = F.col("current_price"), F.col("p50_ton"), F.col("quantity_ton")
    inv, safety, due = F.col("effective_inventory_ton"), F.col("safety_stock_ton"), F.col("inventory_at_due_ton")
    action, code = action_rule(inv, safety, price, p50)
    enough, half_enough, fits = q >= MIN_ORDER_TON, q / 2 >= MIN_ORDER_TON, inv + q <= F.col("warehouse_cap_ton")
    reasons = F.array_compact(F.array(
        F.when(inv < safety, F.concat(F.lit("inventory "), _tons(inv), F.lit(" t is below safety stock "), _tons(safety), F.lit(" t"))),
        F.when(due < safety, F.concat(F.lit(f"inventory when due ({LEAD_DAYS} days) "), _tons(due), F.lit(" t is below safety stock "), _tons(safety), F.lit(" t"))),
    ))
    can_wait = enough & (F.size(reasons) == 0)
    blocked = (action == "Wait") & ~can_wait
    df = df.withColumns({"recommendation": F.when(blocked, "Split").otherwise(action), "reason_code": F.when(blocked, "wait_blocked_inventory_due").otherwise(code)})
    gain = (price - p50) * q
    plan = F.concat(F.lit("today "), _tons(q / 2), F.lit(f" t and after {SPLIT_DAYS} days "), _tons(q / 2), F.lit(" t, both due "), F.date_format("due_date", "yyyy-MM-dd"))
    options = F.array(
        _option("Buy", price * q, gain, enough, F.when(fits, "one purchase").otherwise("above warehouse cap")),
        _option("Split", price * (q / 2) + p50 * (q / 2), gain * 0.5, enough & half_enough, F.when(half_enough, plan).otherwise(F.concat(_tons(q / 2), F.lit(" t a part is below the least order")))),
        _option("Wait", p50 * q, -gain, can_wait, F.when(F.size(reasons) == 0, "possible").otherwise(F.array_join(reasons, "; "))),
    )
    df = df.withColumn("options", options)
    chosen = F.get(F.filter("options", lambda o: o["action"] == F.col("recommendation")), 0)
    pct = (p50 - price) / price * 100
    up, down = p50 > price * (1 + BAND), p50 < price * (1 - BAND)
    reason = (
        F.when(F.col("reason_code") == "inventory_below_safety", F.concat(F.lit("Buy: inventory "), _tons(inv), F.lit(" t is below safety stock "), _tons(safety), F.lit(" t")))
        .when(F.col("reason_code") == "expected_price_up_3pct", F.concat(F.lit("Buy: expected price "), _usd(p50), F.lit(" USD/t is "), F.format_string("%.2f", pct), F.lit(" % above "), _usd(price)))
        .when(F.col("reason_code") == "expected_price_down_3pct", F.concat(F.lit("Wait: expected price "), _usd(p50), F.lit(" USD/t is "), F.format_string("%.2f", F.abs(pct)), F.lit(" % below "), _usd(price)))
        .when(F.col("reason_code") == "wait_blocked_inventory_due", "Split: the price says wait, but stock would fall below safety stock")
        .otherwise("Split: expected price is within 3 % of the current price")
    )
    violations = F.transform(F.filter("options", lambda o: ~o["feasible"]), lambda o: F.struct(o["action"].alias("action"), o["notes"].alias("reason")))
    warnings = F.when(fits, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("stock after delivery "), _tons(inv + q), F.lit(" t is above warehouse cap "), _tons(F.col("warehouse_cap_ton")), F.lit(" t"))))
    return df.withColumns({
        "expected_cost_usd": chosen["expected_cost_usd"], "reward_usd": chosen["reward_usd"], "feasible": chosen["feasible"], "reward_vs_market_pct": F.when(price > 0, F.bround(pct, 4)),
        "price_direction": F.when(up, "up").when(down, "down").otherwise("flat"), "constraint_violations": violations, "constraint_warnings": warnings, "reason": reason,
        "price_summary": F.concat(F.lit("futures "), _usd(price), F.lit(" USD/t (CBOT "), F.format_string("%.2f", F.col("current_price_cbot")), F.lit(f" x {CBOT_TO_TON:.2f}), 30-day average "), F.coalesce(F.concat(_usd(F.col("market_avg_price")), F.lit(" USD/t")), F.lit("unknown"))),
        "risk_note": F.concat(F.lit("in the low case (P10) the price may fall to "), _usd(F.col("p10_ton")), F.lit(" USD/t")),
        "unit_note": F.when(unit == "cbot", f"CBOT quotes times {CBOT_TO_TON} are USD/t").otherwise("forecast given in USD/t"),
        "summary": F.concat(F.lit("futures "), _usd(price), F.lit(f" USD/t, expected after {LEAD_DAYS} days (P50) "), _usd(p50), F.lit(" USD/t")),
        "forecast_summary": F.concat(F.lit("P10 "), _usd(F.col("p10_ton")), F.lit(" / P50 "), _usd(p50), F.lit(" / P90 "), _usd(F.col("p90_ton")), F.lit(" USD/t")),
        "inventory_status": F.concat(F.lit("stock "), _tons(F.col("current_inventory_ton")), F.lit(" + open orders "), _tons(F.col("open_po_ton")), F.lit(" = "), _tons(inv), F.lit(" t; when due "), _tons(due), F.lit(" t; safety "), _tons(safety), F.lit(" t")),
        "split_plan": plan,
    })


def load_context(master: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per series: as_of_date, and its latest close and 30-day average on or before a date (or at all), as quoted
    and per ton. An empty table or a null close is an error; an average may be null."""
    require_columns(master, ["series", "date", "price_close", "market_avg_price_30d"])
    last = latest_asof(master.select("series", "date", "price_close", "market_avg_price_30d"), "series", as_of)
    seen = last.agg(F.count(F.lit(1)).alias("rows"), F.count("price_close").alias("closes")).first()
    if not seen["rows"]:
        raise ValueError("the master table has no row as of the date")
    if seen["closes"] < seen["rows"]:
        raise ValueError("the latest row has no close")
    close, average = F.col("price_close").cast("double"), F.col("market_avg_price_30d").cast("double")
    return last.select(
        "series", F.col("date").alias("as_of_date"), close.alias("current_price_cbot"), average.alias("market_avg_cbot"), (close * CBOT_TO_TON).alias("current_price"), (average * CBOT_TO_TON).alias("market_avg_price")
    )


def with_context(requests: DataFrame, master: DataFrame, as_of: Column | None = None) -> DataFrame:
    """requests with as_of_date, current_price_cbot and market_avg_cbot: the last row of their series in the master on or before
    each request's decision_date; without that column on or before as_of, or at all. Null where there is no such row.

    decision_date becomes as_of_date where requests have none. Requests and prices meet in time order in ranges, so a series
    with very many requests spans several tasks.
    """
    require_columns(master, ["series", "date", "price_close", "market_avg_price_30d"])
    when = F.col("decision_date") if "decision_date" in requests.columns else F.lit(None).cast("date")
    limit = F.coalesce(when.cast("date"), as_of.cast("date") if as_of is not None else F.lit(None).cast("date"), F.lit("9999-12-31").cast("date"))
    quote = F.struct(F.col("date").alias("as_of_date"), F.col("price_close").cast("double").alias("close"), F.col("market_avg_price_30d").cast("double").alias("average"))
    prices = master.where("series IS NOT NULL AND date IS NOT NULL").select("series", F.col("date").cast("date").alias("_limit"), quote.alias("_quote"))
    asked = requests.drop("as_of_date", "current_price_cbot", "market_avg_cbot").withColumn("_limit", limit)
    found = align_asof_long(prices, asked, ["series"], "_limit")
    date = F.col("_quote.as_of_date")
    return found.withColumns({
        "as_of_date": date, "current_price_cbot": F.col("_quote.close"), "market_avg_cbot": F.col("_quote.average"), "decision_date": F.coalesce("decision_date", date) if "decision_date" in requests.columns else date,
    }).drop("_limit", "_quote")


def decision_record(evaluated: DataFrame) -> DataFrame:
    """What the decision log keeps of a recommendation; prices in USD a ton."""
    return evaluated.select(
        "decision_date", "current_price", "market_avg_price", *[F.col(f"{q}_ton").alias(q) for q in ("p10", "p50", "p90")],
        "current_inventory_ton", "safety_stock_ton", F.col("quantity_ton").alias("quantity_requested_ton"), F.col("recommendation").alias("recommended_action"),
    )


def evaluate_scenarios(requests: DataFrame, master: DataFrame | None = None, as_of: Column | None = None, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of the valid requests, and the rejected requests with reasons.

    With master, prices come from the context of each request (with_context), which requests then need not have. A request
    without a price is rejected (reason context). log: a table to which the recommendations are appended.
    """
    if master is not None:
        requests = with_context(requests, master, as_of)
    valid, rejected = split_requests(requests)
    out = evaluate(valid)
    if log:
        log_decisions(decision_record(out), log)
    return out, rejected


def result_document(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """One nested result per request: what was asked, the context, options by action, the summary, and a readable part."""
    have, c = set(evaluated.columns), F.col
    option = lambda name: F.filter("options", lambda o: o["action"] == name)[0].alias(name)
    readable = F.struct(
        c("price_summary").alias("current_price_summary"), "forecast_summary", c("unit_note").alias("forecast_unit"), "price_direction", "recommendation", "reason", "risk_note", "inventory_status", "constraint_warnings", "split_plan", "summary",
    )
    return evaluated.select(
        *keys, "decision_date", *(["as_of_date"] if "as_of_date" in have else []), "due_date", F.lit(LEAD_DAYS).alias("days_to_due_default"), F.round("current_price", 6).alias("current_price"), F.round("market_avg_price", 6).alias("market_avg_price_30d"),
        F.struct(*[c(f"{q}_ton").alias(q) for q in ("p10", "p50", "p90")]).alias("forecast"), "forecast_unit", c("unit_note").alias("forecast_unit_desc"), F.struct("p10", "p50", "p90").alias("forecast_as_given"),
        "current_inventory_ton", "open_po_ton", "effective_inventory_ton", "safety_stock_ton", "quantity_ton", F.round("inventory_at_due_ton", 4).alias("inventory_at_due_ton"),
        F.struct("monthly_consumption_ton", "warehouse_cap_ton", F.lit(MIN_ORDER_TON).alias("moq_min_ton"), F.lit(LEAD_DAYS).alias("lead_days_default"), F.lit(CBOT_TO_TON).alias("cbot_to_usd_per_ton"), F.lit(SPLIT_DAYS).alias("split_interval_days")).alias("system_defaults"),
        c("recommendation").alias("recommended_action"), c("reason_code").alias("recommendation_rule"), F.struct(option("Buy"), option("Split"), option("Wait")).alias("options"),
        F.struct("expected_cost_usd", "reward_usd", "feasible", "reward_vs_market_pct", "constraint_violations").alias("decision_summary"), readable.alias("human_readable"),
    )


def result_json(evaluated: DataFrame) -> DataFrame:
    """One JSON document per request."""
    return evaluated.withColumn("document", F.to_json(F.struct(*evaluated.columns)))


def options_long(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per request and option."""
    return evaluated.select(*keys, F.explode("options").alias("o")).select(*keys, "o.action", "o.expected_cost_usd", "o.risk.*", "o.reward_usd", "o.feasible", "o.notes")
