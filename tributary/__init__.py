"""Tributary: many messy exports in, one reconciled target table out, on Spark.

Every stage takes DataFrames and returns DataFrames; every decision a stage
makes is a row of its output.
"""
