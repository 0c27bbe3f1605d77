"""A transcript store: named tables under one folder, with the operators as methods.

Each table lies in buckets of its keys: a transcript's natural key, a child's transcript, a
machine's name. A change of some transcripts rewrites the buckets that they touch and no
others, and writes a new version of the table; readers keep the version that they opened.
Reading the children of some transcripts opens their buckets only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bucketed import BucketedTable
from .operators import handoff, normalize, recall, search, stats, transfer, vector, watch
from .operators import store as maintenance
from .sources import jsonl

#: Keys that deal a table's rows into buckets; a table that isn't named, or lacks them, is one bucket.
KEYS = {
    "transcripts": ["source", "source_id"], "messages": ["session_id"], "tool_calls": ["session_id"], "embeddings": ["session_id"], "machines": ["name"]
}
CHILDREN = ("messages", "tool_calls", "embeddings")

#: Layers that additions may leave in a bucket before it is written as one.
LAYERS = 8


class TranscriptStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _held(self, name: str, columns: list[str] | None = None) -> BucketedTable:
        keys = KEYS.get(name, [])
        known = columns is None or set(keys) <= set(columns)
        return BucketedTable(self.spark, f"{self.folder}/{name}", keys if known else [], self.buckets)

    def has(self, name: str) -> bool:
        return self._held(name).exists()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The given version of a table, or the latest."""
        rows = self._held(name).read(version)
        if rows is None:
            raise KeyError(f"the store has no table {name}")
        return rows

    def save(self, name: str, rows: DataFrame) -> None:
        """A table anew, all of it."""
        self._held(name, rows.columns).replace(rows)

    def change(self, name: str, touched: DataFrame, changed: Callable[[DataFrame], DataFrame]) -> None:
        """The buckets of the keys in ``touched`` become what ``changed`` makes of their rows."""
        self._held(name).change(touched, changed)

    def add(self, name: str, rows: DataFrame) -> None:
        held = self._held(name)
        held.append(rows)
        held.compact(LAYERS)

    def part(self, name: str, keys: DataFrame) -> DataFrame:
        """All rows of the keys, and others that share their buckets."""
        return self._held(name).part(keys)

    def vacuum(self, keep: int = 2) -> None:
        """Takes away all but the last ``keep`` versions of each table."""
        for name in (*KEYS, "ingestion_state"):
            self._held(name).vacuum(keep)

    def _keys_of(self, ids: DataFrame) -> DataFrame:
        """The natural keys of the transcripts in ``ids`` (id)."""
        return self.table("transcripts").select("id", "source", "source_id").join(
            ids.select("id"),
            "id",
            "left_semi"
        ).select("source", "source_id")

    def upsert_transcripts(self, new: DataFrame) -> None:
        if self.has("transcripts"):
            self.change("transcripts", new, lambda held: maintenance.upserted(held, new, ["source", "source_id"], ["id"]))
        else:
            self.save("transcripts", new)

    def replace_children(self, name: str, new: DataFrame) -> None:
        if self.has(name):
            self.change(name, new, lambda held: maintenance.children_replaced(held, new, "session_id"))
        else:
            self.save(name, new)

    def delete_transcripts(self, gone: DataFrame) -> None:
        """The transcripts in ``gone`` (session_id) go, with their children."""
        ids = gone.select("session_id").distinct()
        without = lambda key: lambda held: maintenance.delete_cascade({"t": (held, key)}, ids)["t"]
        for name in CHILDREN:
            if self.has(name):
                self.change(name, ids, without("session_id"))
        self.change("transcripts", self._keys_of(ids.select(F.col("session_id").alias("id"))), without("id"))

    def rename(self, titles: DataFrame) -> None:
        self.change("transcripts", self._keys_of(titles), lambda held: maintenance.renamed(held, titles))

    def relocate(self, old: str, new: str) -> None:
        """Rewrites the whole table, for a prefix may stand in any row."""
        self.save("transcripts", maintenance.relocated(self.table("transcripts"), old, new))

    def recent(self, limit: int = 20) -> DataFrame:
        return stats.list_transcripts(self.table("transcripts"), limit=limit)

    def resolve(self, identifiers: DataFrame) -> DataFrame:
        return stats.resolve_identifiers(self.table("transcripts"), identifiers)

    def statistics(self) -> DataFrame:
        return stats.by_source(self.table("transcripts"))

    # reading

    def messages(self, ids: DataFrame) -> DataFrame:
        """The messages of the transcripts in ``ids`` (id), in order."""
        own = ids.select(F.col("id").alias("session_id"))
        told = self.part("messages", own).join(own, "session_id", "left_semi")
        return told.orderBy("session_id", "sequence_num", "id")

    def tool_calls(self, ids: DataFrame) -> DataFrame:
        own = ids.select(F.col("id").alias("session_id"))
        told = self.part("tool_calls", own).join(own, "session_id", "left_semi")
        return told.orderBy("session_id", "timestamp", "id")

    def machines(self) -> DataFrame:
        """The registry, most transcripts first."""
        return self.table("machines").orderBy(F.desc("session_count"), "name")

    def commands(self) -> DataFrame:
        return handoff.commands(self.table("tool_calls"))

    def entities(self) -> DataFrame:
        return stats.entities(self.table("transcripts"), self.table("tool_calls"))

    def related(self, wanted: DataFrame, limit: int = 50) -> DataFrame:
        """The newest transcripts of each entity (type, name)."""
        return stats.related_transcripts(self.table("transcripts"), self.table("tool_calls"), wanted, limit)

    def neighborhood(self) -> DataFrame:
        return stats.neighborhood(self.table("transcripts"), self.table("tool_calls"))

    def listed(self, where: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return stats.list_transcripts(self.table("transcripts"), where, limit, offset)

    def detail(self, first: int = 12) -> DataFrame:
        return stats.session_detail(self.table("transcripts"), self.table("messages"), first)

    def totals(self) -> DataFrame:
        return stats.store_totals(self.table("transcripts"), self.table("messages"), self.table("tool_calls"))

    def sizes(self) -> DataFrame:
        return maintenance.size_estimate(self.table("transcripts"), self.table("messages"), self.table("tool_calls"))

    # searching

    def search(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        return search.unified_search(self.table("messages"), self.table("transcripts"), self.table("tool_calls"), queries, limit)

    def search_content(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """The best message of each transcript, with its snippet."""
        return search.search_messages(self.table("messages"), self.table("transcripts"), queries, limit)

    def search_tools(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        return search.search_tools(self.table("tool_calls"), self.table("transcripts"), queries, limit)

    def search_rows(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        return search.session_rows(self.table("transcripts"), queries, limit)

    def semantic_search(self, query_vectors: DataFrame, limit: int = 10) -> DataFrame:
        """Nearest transcripts of (query_id, query_vector); none where the store has no vectors."""
        if not self.has("embeddings"):
            return self.spark.createDataFrame(
                [],
                f"query_id {dict(query_vectors.dtypes)['query_id']}, session_id string, message_id string, cosine double, pos int, snippet string"
            )
        return recall.semantic_hits(self.table("embeddings"), query_vectors, limit=limit)

    def hybrid_search(self, queries: DataFrame, query_vectors: DataFrame, limit: int = 20) -> DataFrame:
        text = self.search(queries, 2 * limit)
        return vector.fused([text, self.semantic_search(query_vectors, 2 * limit)], limit)

    def recall(
        self, queries: DataFrame, query_vectors: DataFrame | None = None, limit: int = 10, resumable: dict[str, str] | None = None
    ) -> DataFrame:
        """Assembled answers; the semantic signal takes part where vectors are stored and asked for."""
        status = recall.semantic_status(query_vectors is not None, self.table("embeddings") if self.has("embeddings") else None)
        near = self.semantic_search(query_vectors, 4 * limit) if status == "used" else None
        return recall.recall_results(
            self.table("messages"),
            self.table("transcripts"),
            self.table("tool_calls"),
            queries,
            limit,
            near,
            status,
            resumable
        )

    def watch_status(self, files: DataFrame, runs: DataFrame) -> DataFrame:
        return watch.status(files, self.table("ingestion_state"), runs)

    # changing

    def put(self, transcripts: DataFrame, messages: DataFrame, calls: DataFrame) -> None:
        """Transcripts with all their children: rows are upserted, children replaced, counts and totals of the touched ones recomputed."""
        self.upsert_transcripts(transcripts)
        keys = transcripts.select("source", "source_id")
        held = self.part("transcripts", keys).select(F.col("id").alias("_id"), "source", "source_id")
        own = transcripts.select(
            F.col("id").alias("session_id"),
            "source",
            "source_id"
        ).join(held, ["source", "source_id"]).select("session_id", "_id")
        touched = own.select(F.col("_id").alias("session_id"))
        for name, rows in (("messages", messages), ("tool_calls", calls)):
            told = rows.join(own, "session_id").withColumn("session_id", F.col("_id")).drop("_id")
            if self.has(name):
                self.change(name, touched, lambda kept, told=told: kept.join(touched, "session_id", "left_anti").unionByName(told))
            else:
                self.save(name, told)
        totals = [c for c in maintenance.TOTALS if c in transcripts.columns]
        counted = transcripts.join(own.withColumnRenamed("session_id", "id"), "id").select(F.col("_id").alias("id"), *totals)
        said, used = self.part("messages", touched), self.part("tool_calls", touched)
        self.change("transcripts", keys, lambda rows: maintenance.recounted(rows, said, used, counted))

    def import_content(self, payload: dict[str, DataFrame], sources: list[str], statuses: list[str]) -> DataFrame:
        """Imports whole payloads (transcripts, messages, tool_calls); one with a row at fault is refused. Returns the report."""
        none = F.lit(None).cast("string")
        head = payload["transcripts"].select("id", "source", "source_id")
        said = payload["messages"].select(F.col("session_id").alias("id"), "role", none.alias("tool_name"), none.alias("status"))
        used = payload["tool_calls"].select(F.col("session_id").alias("id"), none.alias("role"), "tool_name", "status")
        alone = head.select("id", none.alias("role"), none.alias("tool_name"), none.alias("status"))
        errors = normalize.validated(head.join(said.unionByName(used).unionByName(alone), "id"), sources, statuses)
        own = payload["transcripts"].select(F.col("id").alias("session_id"))
        keys = payload["transcripts"].select("source", "source_id").unionByName(self._keys_of(payload["transcripts"])).distinct()
        touched = {"transcripts": keys, "messages": own, "tool_calls": own}
        store = {name: self.part(name, of) for name, of in touched.items()}
        out, report = transfer.content_imported(store, payload, errors.select("id", "error"))
        for name, rows in out.items():
            self.change(name, touched[name], lambda _, rows=rows: rows)
        return report

    def ingest(self, source: str, path: str) -> None:
        """Reads the files of a source below a path and puts what they hold."""
        records = jsonl.reader(source)(self.spark, path)
        messages = normalize.project_messages(records)
        told = normalize.project_transcripts(records, messages).withColumn("source", F.lit(source)).withColumnsRenamed({"file": "source_id"})
        told = told.withColumn("id", F.concat_ws(":", "source", "source_id"))
        owned = lambda rows: rows.withColumn("session_id", F.concat_ws(":", F.lit(source), "file")).drop("file")
        calls = owned(normalize.tool_uses(messages)).withColumn(
            "id",
            F.concat_ws("#", "message_id", F.col("n").cast("string"))
        ).withColumn("tool_output", F.lit(None).cast("string"))
        said = owned(messages).select(
            "id",
            "session_id",
            "source_id",
            "role",
            "content",
            "model",
            "sequence_num",
            "input_tokens",
            "output_tokens",
            "timestamp"
        )
        calls = calls.join(messages.select(F.col("id").alias("message_id"), "timestamp"), "message_id").select(
            "id",
            "session_id",
            "message_id",
            "tool_name",
            "tool_input",
            "tool_output",
            "timestamp"
        )
        self.put(told.withColumn("tool_call_count", F.lit(0).cast("long")), said, calls)

    def embed(self, embed: Callable[[list[str]], list[list[float]]], model: str, limit: int = 200) -> int:
        """Stores vectors of the first messages without one; returns how many chunks."""
        held = self.table("embeddings") if self.has("embeddings") else None
        known = self.spark.createDataFrame([], "message_id string") if held is None else held.select("message_id").distinct()
        new = vector.embedding_run(self.table("messages"), known, embed, model, limit)
        before = 0 if held is None else held.count()
        if held is None:
            self.save("embeddings", new)
        else:
            self.add("embeddings", new)
        return self.table("embeddings").count() - before

    def merge(self, folder: str) -> DataFrame:
        """Brings in what another store holds and this one lacks; returns the report of added rows."""
        other, names = TranscriptStore(self.spark, folder), ("transcripts", "messages", "tool_calls", "embeddings", "machines")
        merged, added = maintenance.stores_merged(
            {n: self.table(n) for n in names if self.has(n)},
            {n: other.table(n) for n in names if other.has(n)}
        )
        report = maintenance.merge_report(added).collect()
        for name, rows in added.items():
            self.add(name, rows)
        if "machines" in merged:
            self.save("machines", merged["machines"])
        return self.spark.createDataFrame(report, "tab string, added long")

    def recompute_machines(self) -> None:
        held = self.table("machines") if self.has("machines") else self.spark.createDataFrame([], "name string, session_count long")
        self.save("machines", maintenance.machines_recounted(held, self.table("transcripts")))

    def export(self, records: DataFrame, folder: str, projects: DataFrame | None = None) -> DataFrame:
        return transfer.export(records, folder, projects)
