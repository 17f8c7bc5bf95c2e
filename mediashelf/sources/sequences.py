"""Serial ids that survive deletions, restarts and several writers.

A ``Sequence`` keeps the highest id that a column was ever given in a folder beside the table. Writers
take ranges from it: a range is given to one writer only, and never again, also after the rows
with the largest ids were deleted or a write failed (which leaves a gap, as a SERIAL does). Taking a range
costs a listing and two empty files, whatever the table's size; without a sequence the largest
id has to be read from the whole id column, and a deleted one is forgotten.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders


class Sequence:
    """The highest id given so far, as the largest ``mark-<id>`` in ``folder``. The writer that creates
    ``after-<id>`` may move the mark on from that id; others wait until it has."""

    def __init__(self, spark: SparkSession, folder: str, patience: float = 60.0):
        self.spark, self.folder, self.patience = spark, folder, patience

    def last(self) -> int:
        return max((int(n[5:]) for n in folders.names(self.spark, self.folder) if n.startswith("mark-")), default=0)

    def take(self, n: int, floor: int = 0) -> int:
        """Reserve ``n`` ids above the mark and above ``floor``; returns the number they follow."""
        until = time.monotonic() + self.patience
        while True:
            last = self.last()
            start = max(last, floor)
            if start + n == last:
                return last
            if folders.claim(self.spark, f"{self.folder}/after-{last}"):
                folders.claim(self.spark, f"{self.folder}/mark-{start + n}")
                return start
            if time.monotonic() > until:
                raise RuntimeError(f"the writer that claimed {self.folder}/after-{last} has not finished; "
                                   "remove that file if it is gone")
            time.sleep(0.05)


def start_after(sequence: Sequence | None, current: DataFrame, id_col: str, floor: int, n: int) -> int:
    """The number that ``n`` new ids follow. With a sequence the table's id column is read
    only once in the sequence's life, to start it."""
    if sequence is not None and sequence.last() > 0:
        return sequence.take(n, floor)
    largest = current.agg(F.max(id_col)).first()[0]
    floor = max(floor, int(largest) if largest is not None else 0)
    return floor if sequence is None else sequence.take(n, floor)
