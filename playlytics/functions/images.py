"""Choice of cover images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playlytics.config import DEFAULT_COVER

ALBUM_JSON = "track struct<album: struct<image: array<struct<`#text`: string>>>>"


def usable_image(url: Column) -> Column:
    """The URL unless it is the site's placeholder."""
    return F.when(~F.contains(url, F.lit(DEFAULT_COVER)), url)


def image_url(art: Column, header: Column) -> Column:
    return F.coalesce(usable_image(art), usable_image(header))


def image_from_json(document: Column) -> Column:
    """The last (largest) album image of an API answer, NULL when a key is missing."""
    images = F.from_json(document, ALBUM_JSON)["track"]["album"]["image"]
    return F.try_element_at(images, F.lit(-1))["#text"]
