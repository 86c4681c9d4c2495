"""Spark-native anti-money-laundering and payment analytics."""
