"""Spark-native analytics over expert-selection traces and the text corpora behind them."""
