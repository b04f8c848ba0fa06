"""A versioned parquet store for the index and incremental re-indexing.

Layout under a root on shared storage::

    <root>/segments/<uuid>/documents/bucket=<b>/     rows of a document bucket
    <root>/segments/<uuid>/postings/bucket=<b>/
    <root>/segments/<uuid>/term_counts/bucket=<b>/   (term, df) of the bucket's documents
    <root>/segments/<uuid>/terms/term_part=<t>/      the same postings, addressed by term
    <root>/segments/<uuid>/paths/path_part=<p>/      (file_path, doc_id, modified_at)
    <root>/segments/<uuid>/info/                     one row: which of these folders exist
    <root>/versions/v00000001-<uuid>/                one manifest row per live bucket

Documents and their postings are dealt by document (``pmod(xxhash64(doc_id), buckets)``),
so a changed document touches one bucket of each. A write makes a new segment that holds
the touched buckets alone, then a manifest that names, for every bucket, the segment it
lives in; untouched buckets are carried over by name. Nothing is ever replaced: a version
counts once Spark has committed its manifest (``_SUCCESS``), a job that dies leaves at
most an unnamed segment, and a retry takes new names. One writer at a time.

What is read follows from what is asked:

* a lookup of terms opens the parts that the terms' hashes name, where rows are sorted by
  term (a frequent term fills several files, split by document) and carry bloom filters;
* a change scan opens the parts that the incoming paths' hashes name;
* document frequencies and totals are merged from the live buckets' ``term_counts`` and
  the manifest's counts; no postings are read.

Rows of ``terms`` and ``paths`` name their bucket and segment, and count while the manifest
has that bucket in that segment. The bucket count is chosen anew when the documents have
outgrown it ``GROWTH`` times.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.functions.stopwords import ENGLISH
from textindex.operators.index import Index, build_index, build_postings, doc_frequency, index_stats
from textindex.operators.inplace import postings_in_place
from textindex.session import ensure_checkpoint_dir

DOCS_PER_BUCKET = 20_000
ROWS_PER_PART = 2_000_000
GROWTH = 4
DOCS_PER_SLICE = 5_000
BROADCAST_IDS = 500_000
POSTING_COLUMNS = ("term", "doc_id", "tf", "positions")


def doc_bucket(doc_id_col, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id_col), F.lit(buckets)).cast("int")


def part_of(name: Column, parts: int) -> Column:
    """The part of ``terms`` or ``paths`` that a term or path falls in; as ``part_number``."""
    return (F.crc32(F.encode(name, "UTF-8")) % parts).cast("int")


def part_number(name: str, parts: int) -> int:
    return zlib.crc32(name.encode()) % parts


@dataclass(frozen=True)
class Segment:
    """What a segment holds: its buckets, those with postings, and its parts."""
    name: str
    buckets: frozenset[int]
    posted: frozenset[int]
    term_parts: int
    terms: frozenset[int]
    path_parts: int
    paths: frozenset[int]


@dataclass(frozen=True)
class Manifest:
    version: str
    buckets: int
    segments: dict[int, str]      # live bucket -> segment
    documents: dict[int, int]     # live bucket -> number of documents
    indexed_at: dict[int, object]
    batch: str | None


class IndexStore:
    """``buckets`` (of documents) and ``parts`` (of terms and of paths) are by default
    chosen from the rows: one for each ``DOCS_PER_BUCKET`` documents or ``ROWS_PER_PART``
    rows."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None,
                 parts: int | None = None, docs_per_bucket: int = DOCS_PER_BUCKET):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.parts = parts
        self.docs_per_bucket = docs_per_bucket
        self._known: dict[str, Segment] = {}    # segments never change

    # -- versions -----------------------------------------------------------
    def _versions(self) -> list[str]:
        """Names of committed versions, in order. A root that does not exist has none;
        one that cannot be read raises."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        path = jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if fs.exists(path(f"{self.root}/versions/{n}/_SUCCESS")))

    def current_version(self) -> str | None:
        versions = self._versions()
        return versions[-1] if versions else None

    def manifest(self, version: str | None = None) -> Manifest | None:
        """The manifest of a version (the current one by default): a row a bucket."""
        version = version or self.current_version()
        if version is None:
            return None
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/versions/{version}").collect()
        live = [r for r in rows if r["bucket"] is not None]
        return Manifest(version, rows[0]["buckets"], {r["bucket"]: r["segment"] for r in live},
                        {r["bucket"]: r["documents"] for r in live},
                        {r["bucket"]: r["indexed_at"] for r in live}, rows[0]["batch"])

    def _publish(self, live: dict[int, tuple], buckets: int, batch: str | None = None) -> str:
        """``live``: bucket -> (segment, documents, indexed_at)."""
        current = self.current_version()
        number = int(current[1:9]) + 1 if current else 1
        version = f"v{number:08d}-{uuid.uuid4().hex[:12]}"
        rows = [(b, s, buckets, n, t, batch) for b, (s, n, t) in sorted(live.items())]
        (self.spark.createDataFrame(rows or [(None, None, buckets, None, None, batch)], MANIFEST).coalesce(1)
         .write.parquet(f"{self.root}/versions/{version}"))
        return version

    # -- segments -----------------------------------------------------------
    def _folder(self, segment: str, table: str) -> str:
        return f"{self.root}/segments/{segment}/{table}"

    def _write_segment(self, index: Index, buckets: int, n: int, kept: Index | None = None,
                       n_kept: int = 0) -> dict[int, tuple]:
        """Write the rows' buckets as a new segment; bucket -> (segment, documents, indexed_at).

        The documents go first. Their postings are made from the texts that were written,
        where they lie, so a token is neither shuffled nor analyzed twice; all other tables
        are made from the postings that were written. ``kept`` are documents and postings
        that are carried over as they are; its documents share no id with the others.
        ``n`` and ``n_kept`` are the numbers of documents: they are dealt by bucket and
        slices of about ``DOCS_PER_SLICE``, without the second pass that ranges are drawn with.
        """
        segment = uuid.uuid4().hex
        bucket = doc_bucket(F.col("doc_id"), buckets)

        def back(rows: DataFrame, table: str) -> DataFrame:
            return self.spark.read.schema(rows.schema).parquet(self._folder(segment, table))

        def save(rows: DataFrame, table: str, by: str = "bucket") -> DataFrame:
            writer = rows.write.mode("append")
            if table == "terms":
                writer = writer.option("parquet.bloom.filter.enabled#term", "true")
            writer.partitionBy(by).parquet(self._folder(segment, table))
            return back(rows, table)

        def write(rows: DataFrame, table: str, *order: str) -> DataFrame:
            return save(rows.repartitionByRange(*order).sortWithinPartitions(*order), table, order[0])

        def deal(rows: DataFrame, table: str, n: int, *order: str) -> DataFrame:
            rows = rows.withColumn("bucket", bucket)
            part = F.pmod(F.hash("doc_id"), F.lit(max(1, -(-n // (buckets * DOCS_PER_SLICE)))))
            return save(rows.repartition("bucket", part).sortWithinPartitions("bucket", *order), table)

        documents = index.documents
        if kept is not None:      # the same columns in all files
            documents = kept.documents.limit(0).unionByName(documents, allowMissingColumns=True)
            carried = kept.documents.unionByName(index.documents.limit(0), allowMissingColumns=True)
        docs = deal(documents, "documents", n, "doc_id")
        posts = self._write_postings(index, docs, n, save, deal)
        if kept is not None:
            deal(carried, "documents", n_kept, "doc_id")
            deal(kept.postings.select(*POSTING_COLUMNS), "postings", n_kept)
            docs, posts = back(docs, "documents"), back(posts, "postings")
        last = F.max("indexed_at") if "indexed_at" in docs.columns else F.lit(None).cast("timestamp")
        held = {r["bucket"]: (segment, r["n"], r["t"]) for r in
                docs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), last.alias("t")).collect()}
        counts = write(posts.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")),
                       "term_counts", "bucket", "term")
        sizes = counts.groupBy("bucket").agg(F.sum("df").alias("n")).collect()
        term_parts = self.parts or max(1, -(-sum(r["n"] for r in sizes) // ROWS_PER_PART))
        order = ("term_part", "term", "doc_id")
        terms = save(posts.select(*POSTING_COLUMNS, part_of(F.col("term"), term_parts).alias("term_part"))
                     .repartitionByRange(*order).sortWithinPartitions(*order)
                     # what is the same or follows from the id is added behind the exchange
                     .withColumn("bucket", bucket).withColumn("segment", F.lit(segment)), "terms", "term_part")
        path_parts = self.parts or max(1, -(-sum(n for _, n, _ in held.values()) // ROWS_PER_PART))
        path_numbers: list[int] = []
        if {"file_path", "modified_at"} <= set(docs.columns):
            paths = write(docs.filter(F.col("file_path").isNotNull()).select(
                "file_path", "doc_id", "modified_at", "bucket", F.lit(segment).alias("segment"),
                part_of(F.col("file_path"), path_parts).alias("path_part")), "paths", "path_part", "file_path")
            path_numbers = _numbers(paths, "path_part")
        row = (sorted(held), sorted(r["bucket"] for r in sizes), term_parts, _numbers(terms, "term_part"),
               path_parts, path_numbers)
        self.spark.createDataFrame([row], INFO).coalesce(1).write.parquet(self._folder(segment, "info"))
        return held

    def _write_postings(self, index: Index, docs: DataFrame, n: int, save, deal) -> DataFrame:
        """Postings of the documents that were written. Rows that share an id, null included,
        are one document, so they meet in a shuffle; all others are grouped where they lie."""
        if index.terms is None:
            return deal(index.postings.select(*POSTING_COLUMNS), "postings", n)
        ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.col("doc_id").alias("_again")).checkpoint(eager=True)
        repeated = ids.count()
        if not repeated:
            return save(postings_in_place(docs, index.terms, ("bucket",)), "postings")
        same = F.col("doc_id").eqNullSafe(F.col("_again"))
        single = docs.join(_ids(ids, repeated), same, "left_anti")
        save(postings_in_place(single, index.terms, ("bucket",)), "postings")
        shared = (docs.join(_ids(ids, repeated), same, "left_semi")
                  .select("doc_id", index.terms.alias("terms")).repartition("doc_id"))
        merged = build_postings(shared.select("doc_id", F.posexplode("terms").alias("pos", "term")))
        return deal(merged.select(*POSTING_COLUMNS), "postings", n)

    def _infos(self, segments: Iterable[str]) -> dict[str, Segment]:
        """What the given segments hold, one row each, read once."""
        names = sorted(set(segments))
        if fresh := [n for n in names if n not in self._known]:
            rows = (self.spark.read.schema(INFO).parquet(*[self._folder(s, "info") for s in fresh])
                    .select("*", F.regexp_extract(F.input_file_name(), "/segments/([0-9a-f]+)/info/", 1).alias("s"))
                    .collect())
            for r in rows:
                self._known[r["s"]] = Segment(
                    r["s"], frozenset(r["buckets"]), frozenset(r["posted"]), r["term_parts"],
                    frozenset(r["terms"]), r["path_parts"], frozenset(r["paths"]))
        return {n: self._known[n] for n in names}

    def _buckets(self, table: str, segments: dict[int, str]) -> DataFrame | None:
        """Rows of a bucketed table in the given buckets; None if there are none.

        A segment that is wanted whole is one folder, whose buckets Spark lists.
        """
        frames, single = [], []
        infos = self._infos(segments.values())
        for name, info in sorted(infos.items()):
            there = info.buckets if table == "documents" else info.posted
            wanted = {b for b, s in segments.items() if s == name} & there
            if wanted and wanted == there:
                frames.append(self.spark.read.parquet(self._folder(name, table)).drop("bucket"))
            else:
                single += [f"{self._folder(name, table)}/bucket={b}" for b in sorted(wanted)]
        if single:
            frames.append(self.spark.read.parquet(*single))
        out = None
        for frame in frames:
            out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
        return out

    def _documents(self, segments: dict[int, str]) -> DataFrame | None:
        return self._buckets("documents", segments)

    def _postings(self, segments: dict[int, str], documents: DataFrame) -> DataFrame:
        found = self._buckets("postings", segments)     # a bucket may hold documents without any term
        if found is not None:
            return found
        kind = documents.schema["doc_id"].dataType.simpleString()
        return self.spark.createDataFrame([], f"term string, doc_id {kind}, tf int, positions array<int>")

    def _live(self, rows: DataFrame, manifest: Manifest, infos: dict[str, Segment]) -> DataFrame:
        """Those rows whose bucket still lives in their segment; a row a bucket is broadcast."""
        whole = all(info.buckets <= {b for b, s in manifest.segments.items() if s == name}
                    for name, info in infos.items())
        if whole:
            return rows
        live = self.spark.createDataFrame(sorted(manifest.segments.items()), "bucket int, segment string")
        return rows.join(F.broadcast(live), ["bucket", "segment"], "left_semi")

    def _addressed(self, table: str, manifest: Manifest, wanted) -> DataFrame | None:
        """Live rows of ``terms`` or ``paths`` in the parts that ``wanted(number of parts)`` names."""
        infos, folders = self._infos(manifest.segments.values()), []
        for name, info in sorted(infos.items()):
            parts, there = ((info.term_parts, info.terms) if table == "terms" else (info.path_parts, info.paths))
            folders += [f"{self._folder(name, table)}/{table[:-1]}_part={p}" for p in sorted(wanted(parts) & there)]
        if not folders:
            return None
        return self._live(self.spark.read.parquet(*folders), manifest, infos)

    # -- write / read -------------------------------------------------------
    def write(self, index: Index, batch: str | None = None) -> str:
        """B1 + B2: write a whole index as a new version, in buckets of its own size."""
        ensure_checkpoint_dir(self.spark)
        n = index.documents.count()
        buckets = self.buckets or max(1, -(-n // self.docs_per_bucket))
        return self._publish(self._write_segment(index, buckets, n), buckets, batch)

    def postings_of(self, terms: Iterable[str], manifest: Manifest | None = None) -> DataFrame | None:
        """A5: postings of the given terms, from the parts that hold them; None if no part does."""
        terms = sorted(set(terms))
        found = self._addressed("terms", manifest or self.manifest(),
                                lambda parts: {part_number(t, parts) for t in terms})
        return None if found is None else found.filter(F.col("term").isin(terms)).select(*POSTING_COLUMNS)

    def read(self, version: str | None = None) -> Index:
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no index version under {self.root}")
        if not manifest.segments:
            raise FileNotFoundError(f"version {manifest.version} holds no documents")
        docs = self._documents(manifest.segments)
        postings = self._postings(manifest.segments, docs)
        counts = self._buckets("term_counts", manifest.segments)
        term_stats = (doc_frequency(postings) if counts is None else
                      counts.groupBy("term").agg(F.sum("df").alias("df")))
        total = sum(manifest.documents.values())
        last = max((t for t in manifest.indexed_at.values() if t is not None), default=None)
        stats = term_stats.agg(F.count(F.lit(1)).alias("total_terms")).select(
            F.lit(total).cast("long").alias("total_documents"), "total_terms",
            F.lit(last).cast("timestamp").alias("last_indexed_at"))

        def postings_of(terms: Iterable[str]) -> DataFrame:
            found = self.postings_of(terms, manifest)
            return postings.limit(0) if found is None else found

        return Index(documents=docs, postings=postings, term_stats=term_stats, stats=stats,
                     postings_of=postings_of, total_documents=total)

    def stored_paths(self, manifest: Manifest, paths: DataFrame) -> DataFrame | None:
        """A4: ``(file_path, doc_id, modified_at, bucket)`` of the stored documents in the
        parts that the column ``file_path`` of ``paths`` falls in."""
        sizes = sorted({i.path_parts for i in self._infos(manifest.segments.values()).values()})
        if not sizes:
            return None
        # at most as many numbers as there are parts
        met = paths.select(*[F.collect_set(part_of(F.col("file_path"), n)).alias(str(n)) for n in sizes]).first()
        found = self._addressed("paths", manifest, lambda parts: set(met[str(parts)]))
        return None if found is None else found.select("file_path", "doc_id", "modified_at", "bucket")

    def update(self, incoming: DataFrame, language: str | None = ENGLISH, stopword_list=None,
               lang_col: str | None = None, stem: bool = False,
               removed_paths: Iterable[str] = (), indexed_at=None, batch: str | None = None) -> str | None:
        """Index the new and modified documents of ``incoming`` and drop those of
        ``removed_paths``; only the buckets they fall in are read and written. Returns
        the new version, or the current one if nothing changed. ``batch`` names the
        micro-batch of a stream: a replay of the last one that was written is known by it.
        """
        ensure_checkpoint_dir(self.spark)
        manifest = self.manifest()
        if manifest is not None and batch is not None and manifest.batch == batch:
            return manifest.version
        if indexed_at is not None:
            incoming = incoming.withColumn("indexed_at", F.lit(indexed_at).cast("timestamp"))
        kwargs = {"text_col": "content", "language": language, "stopword_list": stopword_list,
                  "lang_col": lang_col, "stem": stem}
        if manifest is None or not manifest.segments:
            if incoming.isEmpty():
                return manifest and manifest.version
            return self.write(build_index(incoming, **kwargs), batch)
        kind = incoming.schema["doc_id"].dataType.simpleString()
        nothing = self.spark.createDataFrame([], f"file_path string, doc_id {kind}, modified_at timestamp, bucket int")
        stored = self.stored_paths(manifest, incoming)
        changes = changed_ids(incoming, nothing if stored is None else stored)
        gone = changes.select(F.explode(F.array("doc_id", "old_doc_id")).alias("doc_id"))
        if removed_paths:
            paths = self.spark.createDataFrame([(p,) for p in removed_paths], "file_path string")
            held = self.stored_paths(manifest, paths)
            if held is not None:
                gone = gone.unionByName(held.join(paths, "file_path", "left_semi").select("doc_id"))
        gone = gone.filter(F.col("doc_id").isNotNull()).distinct().checkpoint(eager=True)
        # at most one number for each bucket
        touched = {r["b"] for r in gone.select(
            doc_bucket(F.col("doc_id"), manifest.buckets).alias("b")).distinct().collect()}
        if not touched:
            return manifest.version
        buckets = manifest.buckets
        total = sum(manifest.documents.values()) + changes.filter("change = 'new'").count()
        if self.buckets is None and total > GROWTH * buckets * self.docs_per_bucket:
            buckets, touched = -(-total // self.docs_per_bucket), set(manifest.segments) | touched
        old = {b: s for b, s in manifest.segments.items() if b in touched}
        out, n = _ids(gone, gone.count()), changes.count()
        fresh = build_index(incoming.join(_ids(changes.select("doc_id"), n), "doc_id", "left_semi"), **kwargs)
        kept = None
        if old:
            before = self._documents(old)
            postings = self._postings(old, before).select(*POSTING_COLUMNS).join(out, "doc_id", "left_anti")
            kept = replace(fresh, documents=before.join(out, "doc_id", "left_anti"), postings=postings)
        made = self._write_segment(fresh, buckets, n, kept, sum(manifest.documents[b] for b in old))
        carried = {b: (s, manifest.documents[b], manifest.indexed_at[b])
                   for b, s in manifest.segments.items() if b not in touched}
        return self._publish(carried | made, buckets, batch)


MANIFEST = "bucket int, segment string, buckets int, documents long, indexed_at timestamp, batch string"
INFO = ("buckets array<int>, posted array<int>, term_parts int, terms array<int>, path_parts int, "
        "paths array<int>")


def _ids(ids: DataFrame, n: int) -> DataFrame:
    """The side of a semi or anti join that holds ``n`` ids: broadcast if they are few, else
    hashed a partition at a time, so that the texts or postings beside them are not sorted."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("shuffle_hash")


def _numbers(rows: DataFrame, column: str) -> list[int]:
    """The folders of a table just written: at most one number for each part."""
    return sorted(r[column] for r in rows.select(column).distinct().collect())


def changed_ids(incoming: DataFrame, stored_docs: DataFrame) -> DataFrame:
    """D2 + A4 + E4: ``(file_path, doc_id, old_doc_id, change)`` of incoming documents
    that are new or strictly newer than stored. Only paths, ids and times are joined;
    the result is checkpointed."""
    stored = stored_docs.select("file_path", F.col("doc_id").alias("old_doc_id"),
                                F.col("modified_at").alias("stored_modified_at"))
    joined = incoming.select("file_path", "doc_id", "modified_at").join(stored, "file_path", "left")
    keep = F.col("old_doc_id").isNull() | (F.col("modified_at") > F.col("stored_modified_at"))
    ensure_checkpoint_dir(incoming.sparkSession)
    return (joined.filter(keep)
            .withColumn("change", F.when(F.col("old_doc_id").isNull(), F.lit("new"))
                        .otherwise(F.lit("modified")))
            .select("file_path", "doc_id", "old_doc_id", "change").checkpoint(eager=True))


def reindex(current: Index, incoming: DataFrame, language: str | None = ENGLISH,
            stopword_list=None, lang_col: str | None = None, stem: bool = False) -> Index:
    """G4 on an index that is not stored: drop documents and postings of changed files
    (B4, B5), add their new version, and re-derive ``term_stats`` and ``stats``.
    """
    changes = changed_ids(incoming, current.documents)
    new_docs = incoming.join(changes.select("doc_id"), "doc_id", "left_semi")
    fresh = build_index(new_docs, text_col="content", language=language,
                        stopword_list=stopword_list, lang_col=lang_col, stem=stem)
    gone = (changes.select(F.explode(F.array("doc_id", "old_doc_id")).alias("doc_id"))
            .filter(F.col("doc_id").isNotNull()).distinct())
    kept_docs = current.documents.join(gone, "doc_id", "left_anti")
    kept_post = current.postings.join(gone, "doc_id", "left_anti")
    docs = kept_docs.unionByName(new_docs.select(*kept_docs.columns))
    postings = kept_post.unionByName(fresh.postings.select(*kept_post.columns))
    term_stats = doc_frequency(postings)
    indexed = "indexed_at" if "indexed_at" in docs.columns else None
    return Index(documents=docs, postings=postings, term_stats=term_stats,
                 stats=index_stats(docs, term_stats, indexed))
