"""The reference's analysis bundles as dicts of lazy DataFrames (nothing runs until an action)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import alerts, customers, finance, pricing, products, sales


def profitability_bundle(df: DataFrame, amount: str, cost: str, discount: str, category: str,
                         date: str | None = None, quantity: str | None = None) -> dict[str, DataFrame]:
    return {"discount_impact": pricing.discount_impact(df, discount, amount),
            "discount_effectiveness": pricing.discount_effectiveness(df, discount, amount),
            "optimal_discount_range": pricing.optimal_discount_range(df, discount, amount),
            "price_points": pricing.price_points(df, amount),
            "category_optimisation": pricing.category_optimisation(df, category, amount),
            "financial_kpis": finance.financial_kpis(df, amount, date, quantity),
            "margins": finance.margins(df, amount, cost, category)}


def kpi_bundle(df: DataFrame, amount: str, date: str, tie: str, customer: str) -> dict[str, DataFrame]:
    return {"sales_growth": finance.sales_growth(df, amount, date, tie), "retention": customers.retention(df, customer, date),
            "trend": sales.trend_slope(df, amount, date), "anomalies": sales.anomalies(df, amount)}


def alert_bundle(df: DataFrame, amount: str, date: str, tie: str, customer: str) -> dict[str, DataFrame]:
    w = alerts.early_warnings(df, amount, date, tie, customer)
    return {"alerts": w, "risk_score": alerts.risk_score(w), "concentration": alerts.value_concentration(df, amount),
            "growth": alerts.growth_indicator(df, amount, date)}


def product_bundle(df: DataFrame, product: str, amount: str, date: str) -> dict[str, DataFrame]:
    return {"overview": products.product_overview(df, product),
            "performance": products.product_performance(df, product, amount),
            "trends": products.product_trends(df, product, amount, date)}


def customer_bundle(df: DataFrame, customer: str, amount: str, category: str, date: str,
                    rating: str | None = None) -> dict[str, DataFrame]:
    out = {"value_segments": customers.value_segments(df, amount),
           "frequency_segments": customers.frequency_segments(df, customer),
           "behaviour": customers.behaviour_by_category(df, category, amount),
           "temporal": customers.behaviour_by_time(df, date), "seasonality": customers.seasonality(df, date),
           "value": customers.customer_value_summary(df, customer, amount)}
    if rating:
        out["satisfaction"] = customers.satisfaction(df, rating)
        out["rating_trend"] = customers.rating_trend(df, rating, date)
    return out
