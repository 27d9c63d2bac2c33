"""Token totals by source, language and tokenizer version, kept up by signed deltas in idempotent batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.byte_bpe import coder
from docframe.llm.shared import new_path, pick, slices

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    """Additive totals in a folder that all executors share, kept up by batches that count once.

    apply() sums a batch's changes by key and writes them as a new folder of its own below the
    batch's; it counts once Spark has marked it as whole. Nothing is renamed or written over, so
    this holds on file systems without atomic renames. Batches may be sent again after a failure: of
    several attempts, which hold the same changes, the first by name counts. compact() writes the sum
    of the last base and of the batches that it has listed, with their names, as a new base; batches
    that a base names no longer count by themselves. A base without the mark of its names is none.

    Every reader lists batches before bases, so a batch that was folded and deleted in between is in
    the base read afterwards. Bases are named by their number of batches; each holds all that were
    committed when its writer listed them, so the greatest holds what the others do.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "rollup")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        for d in ("batches", "bases"):
            self._fs.mkdirs(self._path(f"{self.path}/{d}"))

    @staticmethod
    def _folder(batch: str) -> str:
        """Names of batches are kept in hexadecimal, since they may hold anything."""
        name = batch.encode("utf-8")
        if not 0 < len(name) <= 120:
            raise ValueError("a batch's name has 1 to 120 bytes")
        return name.hex()

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))

    def _whole(self, path: str) -> bool:
        return self._fs.exists(self._path(f"{path}/_SUCCESS"))

    def _attempt(self, folder: str) -> str | None:
        """The attempt that counts of a batch; None if none is whole, or if the batch was deleted meanwhile."""
        path = f"{self.path}/batches/{folder}"
        if not self._fs.exists(self._path(path)):
            return None
        return next((f"{path}/{a}" for a in self._names(f"batches/{folder}") if self._whole(f"{path}/{a}")), None)

    def _base(self) -> str | None:
        return next((f"{self.path}/bases/{b}" for b in reversed(self._names("bases")) if self._whole(f"{self.path}/bases/{b}/names")), None)

    def _state(self) -> tuple[str | None, dict[str, str]]:
        """The base, and the attempts of the batches since, by folder. The driver gets names of batches that no compact() has folded yet only."""
        listed = self._names("batches")
        base = self._base()
        folded = set(self._folded(base, listed))
        found = {b: self._attempt(b) for b in listed if b not in folded}
        if any(a is None and not self._fs.exists(self._path(f"{self.path}/batches/{b}")) for b, a in found.items()):
            return self._state()  # deleted meanwhile, so a later base has it
        return base, {b: a for b, a in found.items() if a is not None}

    def _folded(self, base: str | None, folders: list[str]) -> list[str]:
        """Those of the folders that the base names."""
        if base is None or not folders:
            return []
        asked = self.spark.createDataFrame([(f,) for f in folders], "batch string")
        return [r.batch for r in asked.join(self.spark.read.schema("batch string").parquet(f"{base}/names"), "batch", "left_semi").collect()]

    def has(self, batch: str) -> bool:
        folder = self._folder(batch)
        return self._attempt(folder) is not None or bool(self._folded(self._base(), [folder]))

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """deltas: KEYS, n_docs, n_tokens (signed); none at all is a batch too. False if the batch was committed before."""
        if self.has(batch):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        own = f"{self.path}/batches/{self._folder(batch)}/{uuid.uuid4().hex}"
        summed.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(own)
        return self._attempt(self._folder(batch)) in (own, None)

    def _totals(self, base: str | None, attempts: Iterable[str]) -> DataFrame:
        paths = [*attempts, *([f"{base}/totals"] if base else [])]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self, with_empty: bool = False) -> DataFrame:
        """KEYS, n_docs, n_tokens; keys without documents and tokens are left out unless asked for."""
        base, attempts = self._state()
        out = self._totals(base, attempts.values())
        return out if with_empty else out.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds exactly the batches that it lists; one committed meanwhile counts by itself until the next time."""
        base, attempts = self._state()
        if attempts:
            names = self.spark.createDataFrame([(b,) for b in attempts], "batch string")
            before = int(base.rsplit("/", 1)[1].split("-")[0]) if base else 0
            new = f"{self.path}/bases/{before + len(attempts):012d}-{uuid.uuid4().hex}"
            self._totals(base, attempts.values()).where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{new}/totals")
            names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{base}/names")) if base else names
            names.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{new}/names")
        for folder in self._folded(self._base(), self._names("batches")):
            self._fs.delete(self._path(f"{self.path}/batches/{folder}"), True)


def changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed deltas between two states of counts (doc_id, KEYS, n_tokens): deletes, inserts, and revised counts as one of each.

    A null count is 0 tokens; null keys are keys of their own; repeated rows count each. Of two
    states one must be given.
    """
    parts = [
        state.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.coalesce("n_tokens", F.lit(0)).cast("long") * sign).alias("n_tokens"))
        for state, sign in ((before, -1), (after, 1))
        if state is not None
    ]
    if not parts:
        raise ValueError("changes need a state before or after them")
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def counted(docs: DataFrame, version: str, count: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, KEYS, n_tokens) by a column function of the text; null texts have no tokens."""
    rows = pick(docs, id_col, "source", "lang", text_col).toDF("doc_id", "source", "lang", "text")
    return rows.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), count(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"))


def word_count(text: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))


def bpe_counted(docs: DataFrame, version: str, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As counted(), by the byte-level BPE coder."""
    make = coder(docs.sparkSession, vocabulary, pattern)

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = make()
        for batch in batches:
            parts = [bpe.counts(s.column(0)) for s in slices(pa.RecordBatch.from_arrays([batch], ["text"]), 0)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))

    return counted(docs, version, lambda text: tokens(F.make_valid_utf8(text)), id_col, text_col)
