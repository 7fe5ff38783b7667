"""Relational, spatial, topological and matching operators (DataFrame -> DataFrame)."""
