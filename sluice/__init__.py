"""Sluice: sensor-network analytics written as Spark DataFrame plans.

Sub-packages
------------
functions   scalar expressions, window frames, constants
sources     readers, writers, payload parsers
operators   relational and domain operators (DataFrame in, DataFrame out)
plans       multi-operator jobs: feature table, model folds, serving views
streaming   Structured Streaming forms of the poll store and the event detector
"""
