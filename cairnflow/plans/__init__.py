"""Declarative plans (grids, recipes) and the query catalogue with its SQL oracles."""
