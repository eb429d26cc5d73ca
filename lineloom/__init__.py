"""Lineloom: analytics of one-stroke line drawings on Spark."""
