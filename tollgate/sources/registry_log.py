"""Registry entries that are stored: appended once, in order, all entries of an operation together or none.

The log is a folder. ``entries`` holds one folder of Parquet for each operation, ``commits`` one numbered file for each that is
complete. A commit is the renaming of a file to the next number, which the file system does for one writer only; entries without a
commit do not exist for readers. A writer whose state is old finds its number taken, or its entries out of sequence, and is refused.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("model", "number")


class StaleEntriesError(RuntimeError):
    """The entries do not follow those that are stored."""


class RegistryLog:
    """``schema`` is that of the entries: model, number, seq and whatever else describes a change."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._fs.FileContext.getFileContext(self._fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())

    def operations(self) -> list[str]:
        """The operations stored so far, in order. A registry has one for each promotion, import or rollback."""
        if not self._files.util().exists(self._fs.Path(f"{self.path}/commits")):
            return []
        rows = self.spark.read.text(f"{self.path}/commits", wholetext=True).select(F.input_file_name().alias("file"), "value").collect()
        return [r["value"] for r in sorted(rows)]

    def entries(self) -> DataFrame:
        """All entries of complete operations."""
        done = self.operations()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("operation", T.StringType())])).parquet(f"{self.path}/entries")
        return stored.where(F.col("operation").isin(done)).select(*self.schema.names)

    def _check(self, new: DataFrame) -> None:
        """Each version's entries go on where its stored ones end, without gaps and each once."""
        stored = self.entries().groupBy(*KEY).agg(F.max("seq").alias("last"))
        mine = new.groupBy(*KEY).agg(F.min("seq").alias("first"), F.max("seq").alias("final"), F.count(F.lit(1)).alias("n"),
                                     F.count_distinct("seq").alias("different"))
        wrong = mine.join(stored, list(KEY), "left").where(
            (F.col("first") != F.coalesce(F.col("last") + 1, F.lit(0))) | (F.col("different") != F.col("n"))
            | (F.col("final") - F.col("first") + 1 != F.col("n"))).orderBy(*KEY).first()
        if wrong:
            raise StaleEntriesError(f"{wrong['model']}/{wrong['number']}: entry {wrong['first']} does not follow {wrong['last']}")

    def append(self, new: DataFrame, operation: str) -> bool:
        """Store all entries of an operation. False if it is stored already, so a repeated call changes nothing.

        ``operation`` names what is done, once and for all (letters, digits, dot and underscore). Two writers at once: one commits, the other checks its
        entries against the new state and is refused if they no longer follow.
        """
        if not operation.replace(".", "").replace("_", "").isalnum():
            raise ValueError(f"not a name for an operation: {operation}")
        written = False
        while True:
            done = self.operations()
            if operation in done:
                return False
            new = new.select(*self.schema.names)
            self._check(new)
            if not written:
                new.write.mode("overwrite").parquet(f"{self.path}/entries/operation={operation}")
                new = self.spark.read.schema(self.schema).parquet(f"{self.path}/entries/operation={operation}")
                written = True
            if self._commit(len(done), operation):
                return True

    def _commit(self, number: int, operation: str) -> bool:
        """Give a finished file the next number; false if another writer has it."""
        draft = self._fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        folder = self._fs.Path(f"{self.path}/commits")
        make = self.spark._jvm.java.util.EnumSet.of(self._fs.CreateFlag.CREATE)
        parents = self._fs.Options.CreateOpts.createParent()
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self._fs.Options.CreateOpts, 1)
        options[0] = parents
        out = self._files.create(draft, make, options)
        out.write(bytearray(operation.encode()))
        out.close()
        if not self._files.util().exists(folder):
            self._files.mkdir(folder, None, True)
        try:
            self._files.rename(draft, self._fs.Path(folder, f"{number:010d}"), gateway.new_array(self._fs.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            self._files.delete(draft, False)
            return False
        return True
