"""Tables written part by part, with a log of what is committed: a broken run goes on from there, a finished one writes nothing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix.sources import files

LOG = "_parts.json"


class Parts:
    """A folder of ``part=N`` folders under a contract.

    A part counts once the log names it. What the log does not name is deleted before writing goes on; a part that the log names and that is
    missing is an error, and so is a folder of another contract. The number of parts may grow from call to call.
    """

    def __init__(self, spark: SparkSession, folder: str, contract: str, total: int):
        self.spark, self.folder, self.contract, self.total = spark, folder.rstrip("/"), contract, total
        self.log: dict = {"contract": contract, "total": total, "rows": {}, "status": "running"}
        if files.names(spark, self.folder, LOG):
            found = json.loads(files.read_text(spark, f"{self.folder}/{LOG}"))
            if found["contract"] != contract:
                raise ValueError("the folder holds parts of another contract")
            self.log = found | {"total": total}
        elif any(n.startswith("part=") for n in files.names(spark, self.folder)):
            raise RuntimeError("parts exist without a log")
        else:
            self._commit()
        self.reconcile()

    def _commit(self) -> None:
        files.write_text(self.spark, f"{self.folder}/{LOG}", json.dumps(self.log, sort_keys=True))

    @property
    def committed(self) -> set[int]:
        return {int(k) for k in self.log["rows"]}

    def reconcile(self) -> None:
        """Compare the folder with the log."""
        there = {int(n.removeprefix("part=")) for n in files.names(self.spark, self.folder) if n.startswith("part=")}
        wanted = {k for k, n in ((int(k), n) for k, n in self.log["rows"].items()) if n}
        if missing := sorted(wanted - there):
            raise RuntimeError(f"committed parts are missing: {missing[:5]}")
        for k in there - self.committed:
            at, system = files.file_system(self.spark, f"{self.folder}/part={k}")
            system.delete(at, True)

    def write(self, rows_of: Callable[[list[int]], DataFrame], each: int = 64, order: tuple[str, ...] = ()) -> int:
        """Write what is missing, ``each`` parts a job; how many parts were written. ``rows_of`` gives the rows of some parts with a column ``part``."""
        todo = sorted(set(range(self.total)) - self.committed)
        for a in range(0, len(todo), each):
            some = todo[a : a + each]
            rows = rows_of(some).repartition(len(some), "part")
            rows = rows.sortWithinPartitions("part", *order) if order else rows
            rows.write.mode("append").partitionBy("part").option("compression", "zstd").parquet(self.folder)
            there = self.spark.read.schema(rows.schema).parquet(self.folder).where(F.col("part").isin(some))
            counts = {r["part"]: r["count"] for r in there.groupBy("part").count().collect()}
            self.log["rows"] |= {str(k): counts.get(k, 0) for k in some}
            self._commit()
        self.log["status"] = "complete"
        self._commit()
        return len(todo)

    def read(self, schema: str | None = None) -> DataFrame:
        """All committed rows; their number is compared with the log."""
        wanted = sum(self.log["rows"].values())
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(self.folder)
        if (n := rows.count()) != wanted:
            raise RuntimeError(f"the parts have {n} rows, the log {wanted}")
        return rows
