"""Operators over bars; importing this registers all feeds."""

from . import momentum, stats, trend, volatility, volume
from .registry import FEEDS, INDICATORS, Indicator, P, bind_params, feed_ids, indicator, phrase_table, plan_feed, with_feeds

__all__ = ["FEEDS", "INDICATORS", "Indicator", "P", "bind_params", "feed_ids", "indicator", "momentum", "phrase_table", "plan_feed", "stats", "trend", "volatility", "volume", "with_feeds"]
