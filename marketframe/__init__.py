"""marketframe: equity market data as keyed Spark tables, calendars and panels."""
