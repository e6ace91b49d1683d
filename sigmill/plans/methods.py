"""The register of research methods and which of them can be scheduled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Methods by family. A trailing + needs a universe of three or more, # needs several
# instruments at once, ~ needs an order book, * is in use.
METHODS = {
    "template": "template_constrained_search* rule_mining* condition_combination_search* signal_filter_exit_search* preset_expansion* strategy_template_mutation*",
    "optimization": "parameter_sweep* grid_search* random_search* bayesian_optimization genetic_algorithm genetic_programming symbolic_regression evolutionary_strategy_search multi_objective_optimization pareto_frontier_search hyperparameter_optimization complexity_constrained_search top_k_candidate_selection",
    "statistics": "factor_scoring* ic_analysis* rank_ic_analysis* factor_decay_analysis* factor_stability_analysis* cross_symbol_validation+# cross_timeframe_validation out_of_sample_test walk_forward_analysis sensitivity_analysis factor_correlation_analysis factor_redundancy_detection regime_specific_factor_evaluation",
    "ml": "time_series_supervised_learning* time_series_classification* time_series_regression* xgboost_lightgbm_factor_model random_forest_factor_model logistic_regression_signal_model meta_labeling signal_quality_scoring market_regime_clustering change_point_detection anomaly_detection feature_importance_analysis feature_selection",
    "event": "event_study breakout_event_mining pullback_event_mining volume_spike_event_mining large_trader_flow_mining~ exchange_netflow_mining liquidation_event_mining social_sentiment_event_mining news_macro_event_study",
    "funding_basis": "funding_rate_event_mining*",
    "microstructure": "order_flow_mining~ order_book_imbalance_mining~ trade_imbalance_mining liquidity_shock_detection spread_regime_detection~ large_order_impact_analysis~ false_breakout_detection stop_hunting_pattern_detection",
    "portfolio": "strategy_ensemble+ strategy_correlation_mining+ signal_overlap_analysis drawdown_overlap_analysis strategy_portfolio_optimization+ risk_contribution_analysis+ market_beta_exposure_analysis diversification_scoring+",
    "validation": "gate_check_pipeline* minimum_trade_count_check drawdown_concentration_check return_concentration_check parameter_stability_check cross_market_robustness_check cross_period_robustness_check goodhart_detection overfitting_detection backtest_leakage_detection survivorship_bias_check+# transaction_cost_stress_test slippage_stress_test",
}


def rows() -> list[tuple]:
    """(method_id, family, status, min_universe, cross, orderbook, is_ml)"""
    out = []
    for family, names in METHODS.items():
        for mark in names.split():
            name = mark.rstrip("+#~*")
            blocked = any(m in mark for m in "+#~")
            status = "blocked_v1" if blocked else "implemented" if mark.endswith("*") else "planned"
            out.append((name, family, status, 3 if "+" in mark else 1, "#" in mark, "~" in mark, family == "ml"))
    return out


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "method_id string, family string, status string, min_universe int, cross_section boolean, orderbook boolean, is_ml boolean")


def schedulable(spark: SparkSession, universe: int = 2) -> DataFrame:
    return registry(spark).where(f"status = 'implemented' and min_universe <= {int(universe)} and not cross_section")
