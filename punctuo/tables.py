"""The rail tables written once as Parquet, and queries that read them instead of deriving them anew.

The views rebuild journeys and calls from the given tables in every query; a user who asks often writes them once.  Facts
lie in files by time, so that a window prunes row groups, and rows of one train lie together.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from punctuo.views import VIEWS, Views

#: The column by whose ranges each fact is dealt into files and sorted in them.
ORDER = {
    "observations": "recorded_at", "outcomes": "finalised_at", "journeys": "finalised_at", "journey_calls": "rid", "snapshots": "rid",
    "timetable_calls": "operating_date",
}


class Stored(Views):
    """Views of which some are read from a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str, names: list[str]):
        super().__init__(spark, sf_dir)
        self.texts = VIEWS | {n: f"SELECT * FROM parquet.`{folder}/{n}`" for n in names}


def build(spark: SparkSession, sf_dir: str, folder: str, files: int = 8) -> Stored:
    """Write every view as a Parquet table under ``folder`` and return the views over them.

    Facts are dealt by range into ``files`` files (a number to be set by the size of the data) and sorted within; dimensions
    are one file each.
    """
    done: list[str] = []
    for name in VIEWS:  # in order of use, so that each is derived from those already written
        rows = getattr(Stored(spark, sf_dir, folder, done), name)
        if name in ORDER:
            rows = rows.repartitionByRange(files, F.col(ORDER[name])).sortWithinPartitions(ORDER[name])
        else:
            rows = rows.coalesce(1)
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
        done.append(name)
    return Stored(spark, sf_dir, folder, done)
