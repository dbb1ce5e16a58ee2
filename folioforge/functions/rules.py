"""Predicates on users and passwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_LETTERS = 10
LEAST_PASSWORD = 8


def valid_username(c: Column) -> Column:
    """ASCII letters and digits, 1 to 10."""
    return F.coalesce(c.rlike(r"\A[a-zA-Z0-9]+\z") & (F.length(c) <= MOST_LETTERS), F.lit(False))


def valid_password(c: Column) -> Column:
    """ASCII letters and digits, 8 to 10."""
    return F.coalesce(c.rlike(r"\A[a-zA-Z0-9]+\z") & F.length(c).between(LEAST_PASSWORD, MOST_LETTERS), F.lit(False))


def passwords_agree(a: Column, b: Column) -> Column:
    """Not both present and different."""
    return F.coalesce(F.nullif(a, F.lit("")) == F.nullif(b, F.lit("")), F.lit(True))


def may_delete(requester_id: Column, requester_is_superuser: Column, target_id: Column) -> Column:
    """The rule that the deletion itself applies: a superuser, and not oneself."""
    return requester_is_superuser & (requester_id != target_id)


def shows_delete_link(target_is_superuser: Column) -> Column:
    """The rule of the listing: no link beside superusers."""
    return ~target_is_superuser
