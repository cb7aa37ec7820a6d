"""Fitted pipeline stages of our own that can be saved and read with a pipeline."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter

class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc, extraMetadata={"state": self.instance.state()})
        for i, part in enumerate(self.instance.parts()):
            part.write().overwrite().save(f"{path}/parts/{i}")
        for name, table in self.instance.tables().items():
            table.write.parquet(f"{path}/tables/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        return self.cls.restore(DefaultParamsReader.loadMetadata(path, self.sc)["state"], path)


class Saved(Model, MLWritable, MLReadable):
    """A fitted stage: ``state()`` as JSON, ``parts()`` as models of their own and
    ``tables()`` as Parquet."""

    def parts(self) -> list:
        return []

    def tables(self) -> dict:
        return {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)
