"""Tallybook: analytics and settlement of a chat micro-payment ledger on Spark.

Every operator takes and returns DataFrames; nothing here keeps a service,
a connection or a row-at-a-time loop.  See README.md for the operator map.
"""
