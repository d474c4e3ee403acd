"""Typed expressions and the functions that make them."""

from quern.functions.expr import *  # noqa: F403
