"""Runnable jobs: each has run(spark, ...), a command line and a config file beside it."""
