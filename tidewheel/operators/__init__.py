"""Operators on DataFrames: inspection, evaluation, flows, reservoirs, data sets, verification, reports."""
