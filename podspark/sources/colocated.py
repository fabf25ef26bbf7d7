"""Catalogue tables that lie in hash buckets of their key, so that joins on it move nothing stored.

Two tables with the same number of buckets of the same key are joined bucket by bucket.  Where new rows meet
such a table, only the new rows are shuffled, into its buckets.  This suits tables that most runs read or change
as a whole; ``sources.store`` suits those of which a run touches a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from podspark.sources.tables import BUCKETS, shared_folder


def save(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, path: str | None = None, placed: bool = False) -> DataFrame:
    """Writes the table anew and returns it; ``placed`` if the rows already lie by the hash of ``key``, as after a join with such a table.

    The files go below ``path``, or into a new shared folder.  A table cannot be written from itself: give the result another name.
    """
    rows = df if placed else df.repartition(buckets, key)
    folder = path or shared_folder(df.sparkSession)
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)
