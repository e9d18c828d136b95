"""Contents as they are stored, and the undoing of their compression."""

from __future__ import annotations

import base64
import binascii
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(content: str | None, compression: str | None) -> str | None:
    """The content after undoing the compression.

    Where compression says zlib, in any letter case and with blanks around it, content is base64 of zlib bytes of
    UTF-8; what does not decode was marked wrongly and stays as it is. Null stays null.
    """
    if content is None or compression is None or compression.strip().lower() != "zlib":
        return content
    try:
        return zlib.decompress(base64.b64decode(content, validate=True)).decode("utf-8")
    except (binascii.Error, zlib.error, ValueError):
        return content


def undone(content: Column, compression: Column) -> Column:
    """The content of a column after undoing the compression that another column names."""

    @F.pandas_udf("string")
    def run(contents, compressions):
        import pandas as pd

        return pd.Series([decoded(c, z) for c, z in zip(contents, compressions)], dtype=object)

    return run(content, compression)
