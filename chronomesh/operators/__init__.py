"""Estimators and graph operators: functions from DataFrames to DataFrames.

A panel has columns subject, t, roi, x. A matrix is an edge table subject, t, i, j, w that stores each unordered pair
once (i < j); a graph goes with a table of its nodes, so that isolated ones count.
"""
