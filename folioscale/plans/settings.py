"""Settings of a document job, read from the session as ``folioscale.<name>``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from folioscale.sources.records import BUCKETS


@dataclass(frozen=True)
class Settings:
    #: Mean confidence under which a page is read again in other modes.
    retry_below: float = 0.9
    #: Files that one batch of a stream takes at most.
    files_per_batch: int = 1000
    #: Folders that the records of a batch are dealt to by their ids.
    buckets: int = BUCKETS

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Those set in the session, else their defaults; a value that is no positive number of its kind is an error that names its key."""
        found = {}
        for f in fields(cls):
            key, kind = f"folioscale.{f.name}", type(f.default)
            if (raw := spark.conf.get(key, None)) is not None:
                try:
                    found[f.name] = kind(raw)
                except ValueError as e:
                    raise ValueError(f"{key} is {raw!r}, not {kind.__name__}") from e
                if found[f.name] <= 0:
                    raise ValueError(f"{key} is {raw!r}, not positive")
        return cls(**found)
