"""Writing images beside the text that links to them: each executor writes its own rows."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_image_name(data: Column, kind: Column, prefix: str = "") -> Column:
    """The name of a page's image: a prefix, 16 characters made of its bytes, and its ending; jpg is written as jpeg."""
    kind = F.coalesce(F.nullif(kind, F.lit("")), F.lit("png"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(data, 256), 1, 16), F.lit("."), F.when(kind == "jpg", "jpeg").otherwise(kind))


def write_images(images: DataFrame, folder: str, name: str = "saved", data: str = "data") -> None:
    """Writes one file a row into a folder that all executors share. A name that leads out of the folder is an error, and
    a task that runs again writes the same bytes under the same name."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            if row[name] in ("", ".", "..") or posixpath.basename(row[name].replace("\\", "/")) != row[name]:
                raise ValueError(f"not a name of a file: {row[name]!r}")
            target = os.path.join(folder, row[name])
            with open(f"{target}.part", "wb") as f:
                f.write(row[data])
            os.replace(f"{target}.part", target)

    images.select(name, data).where(F.col(data).isNotNull()).foreachPartition(write)
