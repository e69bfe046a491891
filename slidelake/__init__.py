"""Spatial tissue analytics as plain functions over Spark DataFrames."""
