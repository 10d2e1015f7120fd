"""Bounds and name lists that the checking SQL states for itself, apart from the operators that use them."""

# fixed values
RANGES = {
    "RSI_14": (0.0, 100.0),
    "MACD_12_26_9": (-5.0, 5.0),
    "Bollinger_Band_Width": (0.0, 1.0),
    "Return_5min": (-10.0, 10.0),
    "Return_since_open": (-25.0, 25.0),
    "Return_Since_Open_Enhanced": (-25.0, 25.0),
    "Position_in_day_range": (0.0, 1.0),
    "Price_Position_In_Spread": (0.0, 1.0),
    "Intraday_Performance_Percentile": (0.0, 1.0),
    "Spread_Percentile_20": (0.0, 1.0),
    "Volatility_Percentile_100": (0.0, 100.0),
    "Volume_Percentile_Intraday": (0.0, 1.0),
    "Volume_vs_SMA10": (0.0, 100.0),
    "Price_vs_SMA50": (-50.0, 50.0),
    "Order_Book_Imbalance": (-1.0, 1.0),
    "ATR_Stop_Risk_Pct": (0.0, 50.0),
    "Max_Drawdown_30": (-100.0, 0.0),
    "Support_Resistance_Proximity": (0.0, 20.0),
    "Mid_Price_Momentum": (-10.0, 10.0),
    "Price_Acceleration": (-20.0, 20.0),
    "Momentum_Acceleration": (-10.0, 10.0),
    "Momentum_Consistency": (0.0, 1.0),
    "Order_Book_Stability": (0.0, 1.0),
    "Price_Action_Quality": (0.0, 1.0),
}
OUTLIER_BOUNDS = {
    "MACD_12_26_9": (-10.0, 10.0),
    "Return_5min": (-10.0, 10.0),
    "Price_vs_SMA50": (-20.0, 20.0),
    "Volume_vs_SMA10": (0.0, 50.0),
    "Mid_Price_Momentum": (-5.0, 5.0),
    "Momentum_Acceleration": (-5.0, 5.0),
}
FINAL_BOUNDS = {
    "RSI_14": (0.0, 100.0),
    "MACD_12_26_9": (-2.0, 2.0),
    "Return_5min": (-5.0, 5.0),
    "Position_In_Day_Range": (0.0, 1.0),
    "Price_Position_In_Spread": (0.0, 1.0),
    "Order_Book_Imbalance": (-1.0, 1.0),
    "Max_Drawdown_30": (-50.0, 0.0),
}
CATEGORIES = {
    "momentum": ("RSI_14", "MACD_12_26_9", "Mid_Price_Momentum"),
    "returns": ("Return_5min", "Return_since_open", "Return_Since_Open_Enhanced"),
    "risk": ("Max_Drawdown_30", "ATR_Stop_Risk_Pct"),
    "volume": ("Volume_vs_SMA10", "Volume_Percentile_Intraday"),
    "pattern": ("Support_Resistance_Proximity", "Price_vs_SMA50"),
}
PERCENT_COLUMNS = ("Spread_Percentile_20", "Volatility_Percentile_100", "Volume_Percentile_Intraday", "Intraday_Performance_Percentile")
TRAINING_FEATURES = (
    "Time_Of_Day_Cyclical_Sin",
    "Time_Of_Day_Cyclical_Cos",
    "Bid_Ask_Spread_Pct",
    "Volume_Weighted_Order_Book_Imbalance",
    "Volume_Percentile_Intraday",
    "Volume_vs_SMA10",
    "Volatility_Regime_Shift_Norm",
    "Max_Drawdown_Return_Interaction",
    "Support_Momentum_Interaction",
    "Max_Drawdown_30",
    "Return_Since_Open_Enhanced",
    "ATR_Stop_Risk_Pct",
    "Price_vs_SMA50",
    "Support_Resistance_Proximity",
    "RSI_14",
    "Return_5min",
    "Mid_Price_Momentum",
    "Price_Acceleration",
    "RSI_Distance_From_50",
    "Price_Action_Quality",
)
