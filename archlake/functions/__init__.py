"""Dimensions, scalar expressions and row rules."""
