"""Content hashes: XXH3 over Arrow batches, where the hash must be that of the index on disk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xxh3_bytes(data: bytes) -> bytes:
    """XXH3-64 of data as eight bytes, least significant first."""
    import xxhash

    return xxhash.xxh3_64_intdigest(data).to_bytes(8, "little")


class Xxh3:
    """The same hash, taken up piece by piece."""

    def __init__(self):
        import xxhash

        self._state = xxhash.xxh3_64()

    def update(self, data: bytes) -> None:
        self._state.update(data)

    def digest(self) -> bytes:
        return self._state.intdigest().to_bytes(8, "little")


def repo_id(abs_path: str, remote: str | None) -> str:
    import xxhash

    return f"{xxhash.xxh3_64_intdigest((f'remote:{remote}' if remote else f'path:{abs_path}').encode()):016x}"


def xxh3(content: Column) -> Column:
    """XXH3-64 of a binary column; null stays null."""
    import pandas as pd

    def run(s):
        return s.map(lambda b: None if b is None else xxh3_bytes(bytes(b)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(content)
