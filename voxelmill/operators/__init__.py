"""Relational, spatial, graph and ranking operators."""
