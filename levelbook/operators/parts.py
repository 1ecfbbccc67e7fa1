"""A large join in parts of its keys, one after the other, so that its shuffle files need not lie on disk all at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.sources.staging import remove, stage, staged

_PART = "_part"


class JoinParts:
    """``join(left, right)``, a join on ``key``, as frames that hold all rows of some of the keys each.

    As a single job it would keep the shuffle files of both sides and of the join itself until the last row is out.
    Here each side is computed once, and staged under ``path`` in ``parts`` folders by the hash of ``key``. At any time
    there are the staged rows, small as they are, and the shuffle files of one side or of one part. All rows of a key
    are in one part, so no pair is lost or doubled.

    A part is to be written before the next is asked for, as it goes then; so the parts can be gone through once.
    """

    def __init__(
        self,
        left: DataFrame,
        right: DataFrame,
        key: str,
        join: Callable[[DataFrame, DataFrame], DataFrame],
        parts: int,
        path: str,
    ):
        self.sparkSession, self._join, self._parts, self._path = left.sparkSession, join, parts, path

        def dealt(side: DataFrame, name: str) -> DataFrame:
            by_part = side.filter(F.col(key).isNotNull()).withColumn(
                _PART, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
            )
            stage(by_part, f"{path}/{name}", by=_PART)
            return staged(self.sparkSession, f"{path}/{name}", by_part.schema)

        self._right = dealt(right, "right")
        self._left = dealt(left, "left")

    def __len__(self) -> int:
        return self._parts

    def __iter__(self) -> Iterator[DataFrame]:
        try:
            for part in range(self._parts):
                yield self._join(*[side.filter(F.col(_PART) == part).drop(_PART) for side in (self._left, self._right)])
                for name in ("left", "right"):
                    remove(self.sparkSession, f"{self._path}/{name}/{_PART}={part}")
        finally:
            remove(self.sparkSession, self._path)


def store_parts(parts: JoinParts, path: str) -> DataFrame:
    """The rows of all parts, from ``path``."""
    for i, part in enumerate(parts):
        stage(part, path, more=i > 0)
    return staged(parts.sparkSession, path, part.schema)
