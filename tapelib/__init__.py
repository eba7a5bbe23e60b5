"""Spark-native analytics over option trade tapes, OHLC bars, quotes and calendars."""
