"""An index on disk: immutable segments of Parquet and numbered manifests.

A write adds one segment: what it adds, which documents of older segments it deletes, and what both
change in the lexicon. A manifest lists the segments of a version; the highest number is the current
version, and creating its file is the commit, so readers see a write as a whole or not at all and
nothing is ever read and overwritten at once. The work of a write grows with the write, not with the index.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.errors import IndexIOError
from lexquarry.operators.build import Analyzer, IndexTables, token_rows
from lexquarry.plans.session import local_table, spread
from lexquarry.sources.files import Files

_KIND = "inverted-index"
#: A posting carries its document's length, so that ranking reads nothing but the postings of its terms.
_POSTINGS = "term string, doc_id bigint, hit_count bigint, length bigint, positions array<int>"
#: A list of deleted documents up to this many rows is broadcast; its size is known from the manifest.
_FEW_DELETES = 200_000


@dataclass(frozen=True)
class Manifest:
    language: str | None = None
    store: bool = False
    stopwords: tuple[str, ...] = ()
    stem: bool = False
    segments: tuple[str, ...] = ()
    #: Deleted documents by segment that deletes.
    deletes: dict[str, int] = field(default_factory=dict)
    total_documents: int = 0
    total_length: int = 0
    modified_ms: int = 0
    kind: str = _KIND

    @property
    def analyzer(self) -> Analyzer:
        return Analyzer(self.language, self.stopwords, self.stem)


def _version_file(n: int) -> str:
    return f"manifest/v{n:010d}.json"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    # --- versions ---

    def version(self) -> int:
        """The current version's number, 0 if there is no index."""
        names = [n for n in self.files.names("manifest") if n.startswith("v") and n.endswith(".json")]
        return max((int(n[1:-5]) for n in names), default=0)

    def manifest(self) -> Manifest:
        n = self.version()
        if not n:
            raise IndexIOError(f"no index at {self.path}")
        read = json.loads(self.files.read(_version_file(n)))
        if read.get("kind") != _KIND:
            raise IndexIOError(f"{self.path} is no index")
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in read.items()})

    def publish(self, manifest: Manifest, after: int) -> Manifest:
        """Makes the manifest the version that follows ``after``; fails if another writer was faster."""
        done = replace(manifest, modified_ms=int(time.time() * 1000))
        self.files.create(_version_file(after + 1), json.dumps(asdict(done)))
        return done

    def erase(self) -> None:
        """Deletes the index; refuses a path that holds anything else."""
        if self.files.exists() and not self.version() and (not self.files.is_directory() or self.files.names()):
            raise IndexIOError(f"{self.path} holds something that is no index")
        self.files.delete()

    # --- reading ---

    def _read(self, manifest: Manifest, name: str, schema: str) -> DataFrame:
        parts = [
            self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{name}").withColumn("seg", F.lit(i))
            for i, s in enumerate(manifest.segments)
            if name != "deletes" or manifest.deletes.get(s)
        ]
        if not parts:
            return local_table(self.spark, [], schema + ", seg int")
        return reduce(DataFrame.unionByName, parts)

    def _alive(self, manifest: Manifest, rows: DataFrame) -> DataFrame:
        n = sum(manifest.deletes.values())
        if not n:
            return rows.drop("seg")
        gone = self._read(manifest, "deletes", "doc_id bigint").groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("seg").alias("gone_at"))
        if n <= _FEW_DELETES:
            gone = F.broadcast(gone)
        kept = rows.join(gone, F.col("doc_id") == F.col("gone_id"), "left")
        return kept.where(F.col("gone_at").isNull() | (F.col("seg") >= F.col("gone_at"))).drop("seg", "gone_id", "gone_at")

    def documents(self, manifest: Manifest) -> DataFrame:
        return self._alive(manifest, self._read(manifest, "docs", "doc_id bigint, length bigint, data string"))

    def tables(self, manifest: Manifest) -> IndexTables:
        postings = self._alive(manifest, self._read(manifest, "postings", _POSTINGS))
        changes = self._read(manifest, "lexicon", "term string, num_hits bigint, num_docs bigint")
        if len(manifest.segments) == 1:  # has each term once
            lexicon = changes.drop("seg")
        else:
            lexicon = changes.groupBy("term").agg(F.sum("num_hits").alias("num_hits"), F.sum("num_docs").alias("num_docs")).where("num_docs > 0")
        n = manifest.total_documents
        stats = local_table(self.spark, [(n, manifest.total_length / n if n else 0.0)], "total_documents bigint, avg_doc_length double")
        return IndexTables(
            postings.select("term", "doc_id", "hit_count", "length"),
            postings.select("term", "doc_id", F.explode(F.col("positions").cast("array<bigint>")).alias("position")),
            lexicon,
            self.documents(manifest).select("doc_id", "length"),
            stats,
            manifest.analyzer,
            postings.select("term", "doc_id", "positions"),
        )

    # --- writing ---

    def write_segment(self, manifest: Manifest, docs: DataFrame | None, delete: DataFrame | None) -> Manifest:
        """The manifest with one more segment: ``docs(doc_id, texts, data)`` added, the documents in ``delete(doc_id)`` deleted.

        Documents to delete must exist, once each. Nothing is published.
        """
        seg = f"seg-{uuid.uuid4().hex}"
        at = f"{self.path}/{seg}"
        analyzer = manifest.analyzer
        out = manifest
        lexicon = []
        if docs is not None:
            tokens = F.flatten(F.transform("texts", lambda t: analyzer.filtered(t)))
            data = F.col("data") if manifest.store else F.lit(None).cast("string")
            tokens_of = spread(docs).select("doc_id", tokens.alias("tokens"), data.alias("data"))
            tokens_of.select("doc_id", F.size("tokens").cast("bigint").alias("length"), "data").write.parquet(f"{at}/docs")
            rows = token_rows(tokens_of.select("doc_id", "tokens"), analyzer, with_length=True)
            postings = rows.groupBy("term", "doc_id", "length").agg(
                F.count(F.lit(1)).alias("hit_count"), F.sort_array(F.collect_list("position")).alias("positions")
            )
            # Ranges over (term, document), so that a frequent term is spread over several files, and a term's files are few.
            postings.select("term", "doc_id", "hit_count", "length", "positions").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{at}/postings")
            written = self.spark.read.parquet(f"{at}/postings")
            lexicon.append(written.groupBy("term").agg(F.sum("hit_count").alias("num_hits"), F.count(F.lit(1)).alias("num_docs")))
            n, length = self.spark.read.parquet(f"{at}/docs").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            out = replace(out, total_documents=out.total_documents + n, total_length=out.total_length + length)
        else:
            empty = local_table(self.spark, [], "doc_id bigint, length bigint, data string")
            empty.write.parquet(f"{at}/docs")
            local_table(self.spark, [], _POSTINGS).write.parquet(f"{at}/postings")
        if delete is not None:
            delete.select("doc_id").write.parquet(f"{at}/deletes")
            gone = self.spark.read.parquet(f"{at}/deletes")
            tables = self.tables(manifest)
            lost = tables.postings.join(gone, "doc_id", "left_semi").groupBy("term")
            lexicon.append(lost.agg((-F.sum("hit_count")).alias("num_hits"), (-F.count(F.lit(1))).alias("num_docs")))
            n, length = tables.doc_lengths.join(gone, "doc_id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            out = replace(out, total_documents=out.total_documents - n, total_length=out.total_length - length, deletes={**out.deletes, seg: n})
        if lexicon:
            reduce(DataFrame.unionByName, lexicon).groupBy("term").agg(
                F.sum("num_hits").alias("num_hits"), F.sum("num_docs").alias("num_docs")
            ).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/lexicon")
        return replace(out, segments=(*out.segments, seg))

    def compact(self, manifest: Manifest) -> Manifest:
        """The manifest with all segments rewritten as one, without what is deleted."""
        seg = f"seg-{uuid.uuid4().hex}"
        at = f"{self.path}/{seg}"
        self.documents(manifest).write.parquet(f"{at}/docs")
        postings = self._alive(manifest, self._read(manifest, "postings", _POSTINGS))
        postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{at}/postings")
        self.tables(manifest).lexicon.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/lexicon")
        return replace(manifest, segments=(seg,), deletes={})

    def copy_to(self, manifest: Manifest, other: "Store") -> None:
        """The version's segments as files of ``other``, each table by one job without a shuffle, so rows stay sorted where they were."""
        for s in manifest.segments:
            for name in self.files.names(s):
                self.spark.read.parquet(f"{self.path}/{s}/{name}").write.mode("overwrite").parquet(f"{other.path}/{s}/{name}")

    def vacuum(self) -> None:
        """Deletes segments and manifests that the current version doesn't use. No reader may hold an older version."""
        keep, n = set(self.manifest().segments), self.version()
        for name in self.files.names():
            if name.startswith("seg-") and name not in keep:
                self.files.delete(name)
        for name in self.files.names("manifest"):
            if f"manifest/{name}" != _version_file(n):
                self.files.delete(f"manifest/{name}")


