"""Corpus and index as one store whose state changes as a whole.

Parts are written to fresh folders; a numbered manifest then names all parts of
corpus and index together.  Readers follow the newest manifest, so they see both
tables before or after a change, never between, and what a failed or replayed
job left behind is not named by any manifest.  A manifest's number can be taken
once: of two jobs that start from the same state, the later one is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from passagemill.sources import schema as S

NAME = "manifest-{:012d}.json"


class Conflict(RuntimeError):
    """Another job has changed the store since the snapshot was taken."""


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    corpus: tuple[str, ...] = ()
    index: tuple[str, ...] = field(default=())


class Store:
    """Snapshots below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        self._fs = self._folder.getFileSystem(self._conf)

    def latest(self) -> Snapshot:
        """The newest state; an empty one where nothing was committed yet."""
        if not self._fs.exists(self._folder):
            return Snapshot()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        names = sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
        return self.at(int(names[-1][len("manifest-"):-len(".json")])) if names else Snapshot()

    def at(self, version: int) -> Snapshot:
        """An earlier state, as long as its parts are kept."""
        if not version:
            return Snapshot()
        text = self.spark.read.text(f"{self.path}/manifests/{NAME.format(version)}", wholetext=True).first()[0]
        found = json.loads(text)
        return Snapshot(version, tuple(found["corpus"]), tuple(found["index"]))

    def write_part(self, df: DataFrame, kind: str, name: str | None = None) -> str:
        """Write rows to a fresh folder; it belongs to no state until it is committed.

        A ``name`` of the caller's own lets a repeated job replace what it left behind.
        """
        mode = "errorifexists" if name is None else "overwrite"
        name = name or f"{kind}-{uuid.uuid4().hex}"
        df.write.mode(mode).parquet(f"{self.path}/parts/{name}")
        return name

    def add(self, corpus=(), index=()) -> Snapshot:
        """Further parts after whatever is newest; those that are named already stay as they are."""
        while True:
            base = self.latest()
            more = [p for p in corpus if p not in base.corpus], [p for p in index if p not in base.index]
            if not any(more):
                return base
            try:
                return self.commit(base, *more)
            except Conflict:
                continue

    def commit(self, base: Snapshot, corpus=(), index=(), replace: bool = False) -> Snapshot:
        """The state after ``base`` with further parts, or with these alone."""
        kept = Snapshot(base.version) if replace else base
        new = Snapshot(base.version + 1, (*kept.corpus, *corpus), (*kept.index, *index))
        body = json.dumps({"corpus": new.corpus, "index": new.index}).encode()
        jvm = self.spark._jvm
        hpath = jvm.org.apache.hadoop.fs.Path
        self._fs.mkdirs(self._folder)
        draft = hpath(self._folder, f".draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(body))
        out.close()
        final = hpath(self._folder, NAME.format(new.version))
        options = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 0)
        try:  # fails where the name is taken
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            context.rename(draft, final, none)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {new.version} was committed by another job") from error
            raise
        return new

    def reset(self) -> Snapshot:
        """An empty corpus and index."""
        return self.commit(self.latest(), replace=True)

    def corpus(self, snapshot: Snapshot | None = None) -> DataFrame:
        parts = (snapshot or self.latest()).corpus
        if not parts:
            return self.spark.createDataFrame([], S.CHUNK)
        return self.spark.read.schema(S.CHUNK).parquet(*(f"{self.path}/parts/{p}" for p in parts))

    def index(self, snapshot: Snapshot | None = None) -> DataFrame:
        parts = (snapshot or self.latest()).index
        if not parts:
            raise FileNotFoundError(f"no index in {self.path}; build it first")
        return self.spark.read.parquet(*(f"{self.path}/parts/{p}" for p in parts))

    def index_matches(self, snapshot: Snapshot | None = None) -> bool:
        """Whether every chunk of the corpus is indexed and nothing else is."""
        state = snapshot or self.latest()
        own = self.corpus(state).select("chunk_id")
        if not state.index:
            return own.isEmpty()
        other = self.index(state).select("chunk_id")
        return own.join(other, "chunk_id", "left_anti").isEmpty() and other.join(own, "chunk_id", "left_anti").isEmpty()
