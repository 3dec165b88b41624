"""Seeded draws that depend on (row, position, seed) only.

A draw is the same whatever the partitioning, the order of rows or the number of retries, and any
other SQL engine can replay it with 64-bit integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed values of the draw: a Mersenne prime modulus and two multipliers below 2^17.
MODULUS = 2147483647
ROW_FACTOR = 69621
POSITION_FACTOR = 48271
OFFSET = 11
# Keys are draw * KEY_SHIFT + position, so equal draws are ordered by position.
KEY_SHIFT = 2147483648


def seed_for(seed: int, relation: int = 0, index: int = 0, salt: int = 0) -> int:
    """One seed per (run seed, relation id, input index, purpose)."""
    return (seed * 1000003 + relation * 10007 + index * 101 + salt * 7919) % MODULUS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside one expression.

    A lambda body is evaluated per element, and a column that is used in it may be inlined there. Values that do not
    depend on the element are therefore bound outside, or a text of n words costs n times its own parsing.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mix(first: Column) -> Column:
    return ((first * first + F.lit(OFFSET)) % MODULUS * F.lit(POSITION_FACTOR) + first) % MODULUS


def _first(row: Column, position: Column, seed: int) -> Column:
    row = F.pmod(row.cast("bigint"), F.lit(MODULUS).cast("bigint"))
    return (row * F.lit(ROW_FACTOR) + position.cast("bigint") * F.lit(POSITION_FACTOR) + F.lit(seed)) % MODULUS


def draw(row: Column, position: Column, seed: int) -> Column:
    """A number in [0, MODULUS) for a position (counted from 1) of a row."""
    return let(_first(row, position, seed), _mix)


def draw_keys(items: Column, row: Column, seed: int, eligible: Callable[[Column], Column] | None = None) -> Column:
    """One sortable key per array item; null where the item is not eligible."""
    firsts = F.transform(
        items,
        lambda x, i: F.when(eligible(x), _first(row, i + 1, seed)) if eligible else _first(row, i + 1, seed),
    )
    return F.transform(firsts, lambda h, i: _mix(h) * F.lit(KEY_SHIFT) + i)


def kth_key(keys: Column, k: Column) -> Column:
    """The k-th smallest non-null key; null when k is 0, so that no comparison with it is true."""
    return F.get(F.sort_array(F.filter(keys, lambda x: x.isNotNull())), k.cast("int") - 1)


def edit_chosen(
    items: Column,
    row: Column,
    seed: int,
    count: Callable[[Column], Column],
    edit: Callable[[Column, Column], Column],
    eligible: Callable[[Column], Column] | None = None,
) -> Column:
    """Choose ``count(n)`` of the n eligible items without replacement and map each with ``edit(item, key)``.

    Selection is by comparison with the k-th key: one sort per row, never a list of chosen positions.
    """

    def apply(bound: Column) -> Column:
        threshold = bound["threshold"]
        return F.zip_with(
            bound["items"],
            bound["keys"],
            lambda x, key: F.when(key <= threshold, edit(x, key)).otherwise(x),
        )

    def with_threshold(bound: Column) -> Column:
        eligible_count = F.size(F.filter(bound["keys"], lambda x: x.isNotNull()))
        return F.struct(
            bound["items"].alias("items"),
            bound["keys"].alias("keys"),
            kth_key(bound["keys"], count(eligible_count)).alias("threshold"),
        )

    def with_keys(bound: Column) -> Column:
        return F.struct(bound.alias("items"), draw_keys(bound, row, seed, eligible).alias("keys"))

    return let(let(let(items, with_keys), with_threshold), apply)


def shuffle(items: Column, row: Column, seed: int) -> Column:
    """The items in the order of their draws."""

    def order(bound: Column) -> Column:
        pairs = F.zip_with(draw_keys(bound, row, seed), bound, lambda k, x: F.struct(k.alias("k"), x.alias("x")))
        return F.transform(F.sort_array(pairs), lambda p: p["x"])

    return let(items, order)
