"""Article sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the section list of print front-page copies.
FRONT_PAGE = "Seite 1"


def first_section(sections: Column) -> Column:
    """The first section, or null for a null or empty list."""
    return F.try_element_at(sections, F.lit(1))


def sections_from_url(url: Column) -> Column:
    """Folders of the URL path: ``/a/b/c.html`` gives ``[a, b]``."""
    path = F.when(url.startswith("/"), F.regexp_extract(url, "^([^?#]*)", 1)).otherwise(
        F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    )
    parts = F.split(path, "/")
    return F.when(url.isNotNull(), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(
        F.array().cast("array<string>")
    )


def is_front_page(sections: Column, name: str = FRONT_PAGE) -> Column:
    """True when the list holds that one section and nothing else; never null."""
    return sections.eqNullSafe(F.array(F.lit(name)))
