"""Reuse of built Column expressions.

A page audit is one projection of about a hundred columns.  Building them takes
thousands of calls into the JVM, so a built set is kept per Spark application.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext


def built_once(build: Callable):
    """Cache the result of a zero-argument Column builder per application."""
    cache: dict[str, object] = {}

    @functools.wraps(build)
    def wrapper():
        app = SparkContext.getOrCreate().applicationId
        if app not in cache:
            cache.clear()
            cache[app] = build()
        return cache[app]

    return wrapper
