"""Explicit schemas of the input tables (DDL strings; CSV and JSON are never inferred)."""

PRICES = (
    "ticker string, date date, open double, high double, low double, close double, volume double, "
    "adjOpen double, adjHigh double, adjLow double, adjClose double, adjVolume double"
)
DAILY_METRICS = (
    "ticker string, date date, marketCap double, peRatio double, pbRatio double, trailingPEG1Y double"
)
STATEMENTS = (
    "ticker string, date_available date, fiscal_year int, fiscal_quarter int, statement_type string, "
    "data_code string, value double"
)
CONSTITUENTS = "Symbol string, Security string, sector string, sub_industry string"
INDEX_DAILY = "date date, open double, high double, low double, close double, adj_close double, volume double"
CURVE = "month date, portfolio_return double, pnl double, equity double, prev_equity double, n_positions int"
STATE = "last_rebalance string, strategies map<string, struct<holdings: array<string>>>"
