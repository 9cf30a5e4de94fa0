"""Bindings of the operators to the driver tables, each next to its check SQL."""
