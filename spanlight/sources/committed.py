"""A table that grows by whole batches, each exactly once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class CommittedTable:
    """Rows in batches with names of their own, in a folder that all executors share.

    The files of a batch are written first, into a folder of this attempt; then a small file that
    names it is renamed to the batch's name. Only what such a file names is read. A batch that is added again, after a
    failure or by another writer, changes nothing: either its name is there and nothing is written, or the
    rename finds it and the attempt's files go. Files of attempts that died before their rename are
    never read; `sweep` deletes them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("commits").getFileSystem(self._conf)

    def batches(self) -> dict[str, str]:
        """The committed batches and the folders of their files."""
        fs = self._fs()
        if not fs.exists(self._at("commits")):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(self._at("commits"))]
        # A commit's name is `<batch>`; its content is the attempt's folder, whose name holds the batch as well.
        return {n: self.text(f"commits/{n}") for n in sorted(names) if not n.startswith((".", "_"))}

    def text(self, name: str) -> str:
        """A small file's content."""
        stream = self._fs().open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Writes a small file."""
        out = self._fs().create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def names(self, folder: str) -> list[str]:
        """What lies in a folder."""
        return [s.getPath().getName() for s in self._fs().listStatus(self._at(folder))]

    def delete(self, name: str) -> None:
        """Deletes a file or a folder of the table."""
        self._fs().delete(self._at(name), True)

    def attempt(self, batch: str) -> str:
        """A new folder for a batch's files."""
        return f"data/{batch}-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame, batch: str) -> bool:
        """Writes the rows as a batch, unless it is there; tells whether it did."""
        fs = self._fs()
        if fs.exists(self._at(f"commits/{batch}")):
            return False
        attempt = self.attempt(batch)
        rows.write.parquet(f"{self.path}/{attempt}")
        return self.commit(attempt, batch)

    def commit(self, attempt: str, batch: str) -> bool:
        """Makes a written attempt the batch, if there is none yet."""
        fs = self._fs()
        fs.mkdirs(self._at("commits"))
        name = f"notes/{attempt.rpartition('/')[2]}"
        self.write_text(name, attempt)
        note = self._at(name)
        context = self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf)
        how = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        how[0] = getattr(self._hadoop, "Options$Rename").NONE
        try:
            context.rename(note, self._at(f"commits/{batch}"), how)  # fails if the name is there
        except Exception:
            fs.delete(note, False)
            if not fs.exists(self._at(f"commits/{batch}")):
                raise
            fs.delete(self._at(attempt), True)
            return False
        return True

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        folders = list(self.batches().values())
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def sweep(self) -> int:
        """Deletes the files of attempts that no commit names; nothing else may be writing. Returns how many."""
        fs, kept = self._fs(), set(self.batches().values())
        if not fs.exists(self._at("data")):
            return 0
        lost = [s.getPath() for s in fs.listStatus(self._at("data")) if f"data/{s.getPath().getName()}" not in kept]
        for p in lost:
            fs.delete(p, True)
        return len(lost)
