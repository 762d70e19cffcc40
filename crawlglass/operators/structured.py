"""JSON-LD: declared types, and required properties that are missing.

JSON-LD is the one input without a schema: any nesting, any key order.  A small
Arrow-batched helper walks each page's scripts with the standard JSON parser;
only the script texts travel to Python, and the work stays row-local.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Properties a rich result of the type needs.
SCHEMA_REQUIRED = {
    "Article": ["headline", "image"],
    "NewsArticle": ["headline", "image"],
    "BlogPosting": ["headline", "image"],
    "Product": ["name", "image"],
    "Recipe": ["name", "image"],
    "Event": ["name", "startDate"],
    "Organization": ["name"],
    "LocalBusiness": ["name", "address"],
    "BreadcrumbList": ["itemListElement"],
    "FAQPage": ["mainEntity"],
    "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
    "JobPosting": ["title", "datePosted", "hiringOrganization"],
}

JSONLD_TYPE = "struct<types:array<string>,gaps:array<string>,invalid:int>"


def _objects(document) -> Iterator[dict]:
    """Every JSON object, parents first, in document order."""
    pending = [document]
    while pending:
        node = pending.pop()
        if isinstance(node, dict):
            yield node
            pending.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            pending.extend(reversed(node))


def scan_scripts(scripts) -> tuple[list[str], list[str], int]:
    """Types, distinct gap messages and number of invalid scripts of one page."""
    types: list[str] = []
    gaps: dict[str, None] = {}
    invalid = 0
    for script in scripts if scripts is not None else ():
        try:
            document = json.loads(script or "{}")
        except (ValueError, RecursionError):
            invalid += 1
            continue
        for node in _objects(document):
            declared = node.get("@type")
            names = [t for t in (declared if isinstance(declared, list) else [declared]) if isinstance(t, str)]
            types.extend(names)
            for name in names:
                missing = [prop for prop in SCHEMA_REQUIRED.get(name, ()) if not node.get(prop)]
                if missing:
                    gaps[f"{name} schema missing required: {', '.join(missing)}"] = None
    return types, list(gaps), invalid


def scan_jsonld(scripts: Column) -> Column:
    """``struct<types, gaps, invalid>`` of an array of script texts; pages without scripts send nothing and are not looked at."""

    def scan(batch: pd.Series) -> pd.DataFrame:
        found: list[tuple] = [([], [], 0)] * len(batch)
        for i in np.flatnonzero(batch.notna().to_numpy()):
            found[i] = scan_scripts(batch.iloc[i])
        return pd.DataFrame(found, columns=["types", "gaps", "invalid"])

    return F.pandas_udf(scan, JSONLD_TYPE)(F.when(F.size(scripts) > 0, scripts))


# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
