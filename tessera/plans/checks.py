"""Argument checks that fail while a plan is built, not while it runs."""

from __future__ import annotations


def positive(value: int, name: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise ValueError(f"{name} must be a positive whole number, not {value!r}")
    return value


def non_negative(value: int, name: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise ValueError(f"{name} must be a whole number from 0, not {value!r}")
    return value


def bit_index(value: int, width: int = 32) -> int:
    if not 0 <= value < width:
        raise ValueError(f"bit index {value} is outside 0..{width - 1}")
    return value
