"""Operator 4: token counts as delta-maintained rollups.

A batch is a set of changes (insert, delete or revise a document's token count) that is summed to
signed deltas by source, language and tokenizer version. A store is a folder:

    data/<attempt>/       the deltas of one attempt at a batch, as Parquet
    commits/<batch>       one line, the attempt that is the batch
    snapshots/<number>    one line, the folder of a snapshot: sums, and the batches they hold

A batch becomes visible when its commit file takes its name, by a rename that never replaces a file
(atomic on HDFS; a local file system has one writer). A batch id that is there already is left as it
is, so a retried or repeated commit changes nothing, and what attempts left behind is never read.
Totals are sums of deltas, so batches can be committed in any order; `compact` folds the committed
batches into a snapshot, and totals read the newest one and later batches only.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import by_bytes, default_path, encoder
from .common import Scratch, load, tune

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs long, tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (kind, source, lang, version, tokens, old_tokens).

    insert adds a document and its tokens; delete takes them away; revise puts tokens in the place
    of old_tokens, which were counted under old_source, old_lang and old_version where the table has
    these columns, else under the same keys. Null counts are 0; other kinds are an error when the
    batch is summed. Null source, lang and version are keys; repeated rows are changes of their own;
    an empty table has no deltas; other columns are ignored.
    """
    count = lambda c, sign: (F.coalesce(c, F.lit(0)) * sign).cast("long").alias("tokens")
    part = lambda sign, tokens, old="": F.struct(*(F.col(old + k if old + k in changes.columns else k).cast("string").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("docs"), count(tokens, sign))
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast(f"array<struct<{DELTA.replace(' ', ':').replace(',:', ',')}>>")
    parts = F.when(F.col("kind") == "insert", F.array(part(1, F.col("tokens")))).when(F.col("kind") == "delete", F.array(part(-1, F.col("tokens"))))
    parts = parts.when(F.col("kind") == "revise", F.array(part(1, F.col("tokens")), part(-1, F.col("old_tokens"), "old_"))).otherwise(wrong)
    return changes.select(F.inline(parts)).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Store:
    """Files of a store, through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.hadoop, self.conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [n for x in self.fs.listStatus(p) if not (n := x.getPath().getName()).startswith((".", "_"))] if self.fs.exists(p) else []

    def publish(self, name: str, line: str) -> bool:
        """Make the file `name` with one line, unless it is there."""
        target, staged = self.path(name), self.path(f"staged/{uuid.uuid4().hex}")
        if self.fs.exists(target):
            return False
        out = self.fs.create(staged, False)
        out.write(bytearray(line.encode()))
        out.close()
        self.fs.mkdirs(target.getParent())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)  # replace nothing
        try:
            self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(staged, target, none)
        except Exception:
            self.fs.delete(staged, False)
            if self.fs.exists(target):  # another writer was faster
                return False
            raise
        return True

    def lines(self, folder: str, names: list[str]) -> dict[str, str]:
        """The lines of some files of a folder."""
        if not names:
            return {}
        read = self.spark.read.text([str(self.path(f"{folder}/{n}").toString()) for n in names])
        return {r.name.rpartition("/")[2]: r.value for r in read.select(F.col("_metadata.file_path").alias("name"), "value").collect()}

    def latest(self) -> tuple[str | None, list[str]]:
        """The folder of the newest snapshot (None without one), and the committed batches that it doesn't hold."""
        last = max(map(int, self.names("snapshots")), default=None)
        folder = None if last is None else self.lines("snapshots", [str(last)])[str(last)]
        folded = set() if folder is None else {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.root}/{folder}/batches").collect()}
        return folder, sorted(set(self.names("commits")) - folded)

    def sums(self, folder: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.root}/data/{a}" for a in self.lines("commits", batches).values()]
        if folder is not None:
            paths.append(f"{self.root}/{folder}/sums")
        read = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return read.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def commit(spark: SparkSession, store: str, batch: str, changes: DataFrame) -> bool:
    """Add a batch of changes to the store; False if the batch is there already."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"not a batch id: {batch!r}")
    own, attempt = Store(spark, store), f"{batch}-{uuid.uuid4().hex}"
    if own.fs.exists(own.path(f"commits/{batch}")):
        return False
    deltas(changes).write.parquet(f"{store}/data/{attempt}")
    if own.publish(f"commits/{batch}", attempt):
        return True
    own.fs.delete(own.path(f"data/{attempt}"), True)
    return False


def compact(spark: SparkSession, store: str) -> bool:
    """Fold the committed batches into a new snapshot; False if there is nothing to fold, or another writer was faster."""
    own = Store(spark, store)
    folder, new = own.latest()
    if not new:
        return False
    number = max(map(int, own.names("snapshots")), default=-1) + 1
    made = f"folded/{number}-{uuid.uuid4().hex}"
    own.sums(folder, new).write.parquet(f"{store}/{made}/sums")
    batches = spark.createDataFrame([(b,) for b in new], "batch string")
    if folder is not None:
        batches = batches.unionByName(spark.read.schema("batch string").parquet(f"{store}/{folder}/batches"))
    batches.write.parquet(f"{store}/{made}/batches")
    if own.publish(f"snapshots/{number}", made):
        return True
    own.fs.delete(own.path(made), True)
    return False


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, version, docs, tokens over the committed batches; keys without documents and tokens are left out."""
    own = Store(spark, store)
    return own.sums(*own.latest()).where("docs <> 0 or tokens <> 0")


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang, version, tokens and chars of each row of (doc_id, source, lang, text).

    Null and empty texts have 0 of both; null ids, sources and languages stay; repeated rows are
    counted each; an empty table gives no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    file = tokenizer or default_path()

    def run(batches):
        enc = encoder(file)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = []
            for a, b in by_bytes(texts):
                index, counts = enc.chunks(texts[a:b])
                lens = enc.len[index]
                at = 0
                for c in counts.tolist():
                    n.append(int(lens[at : at + c].sum()))
                    at += c
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("source"), batch.column("lang"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64()), pa.array([len(t) if t else 0 for t in texts], pa.int64())], ["doc_id", "source", "lang", "version", "tokens", "chars"])
        enc.rest_now()

    return docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long, chars long")


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under two tokenizer versions; the second is counted by characters at first and then revised. Each batch is committed twice."""
    store = Scratch(spark, "rollup")
    docs = load(spark, sf_dir, "documents")
    counted = store.keep(count_tokens(docs), "counted")
    change = lambda kind, version, tokens, old=None: counted.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(version).alias("version"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))
    batches = {
        "characters": change("insert", "characters", "chars"),
        "estimate": change("insert", "byte_bpe_50k", "chars"),
        "exact": change("revise", "byte_bpe_50k", "tokens", "chars"),
        "withdrawn": change("delete", "characters", "chars").where("lang is null"),
    }
    for name, changes in batches.items():
        commit(spark, store.path("store"), name, changes)
        commit(spark, store.path("store"), name, changes)
    return totals(spark, store.path("store"))
