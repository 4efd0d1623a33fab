"""Expressions that are built once in an application."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark.sql import SparkSession

Made = TypeVar("Made")


def once(build: Callable[..., Made]) -> Callable[..., Made]:
    """Keep what ``build`` returns for its arguments: columns over fixed names. The driver takes seconds to put thousands of expressions together, whatever the size of the data."""
    made: dict[tuple, Made] = {}

    @wraps(build)
    def of(*args) -> Made:
        key = (SparkSession.getActiveSession().sparkContext.applicationId, *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return of
