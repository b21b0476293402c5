"""The stored index: domains, pages, edges and meta as hash-split Parquet tables with a manifest."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import index as I
from webloom.session import cut_lineage
from webloom.sources.shared_files import SharedFiles

SCHEMAS = {
    "edges": (
        "source_url string, target_url string, source_domain string, target_domain string, anchor string, "
        "internal int, nofollow int, first_seen bigint, last_seen bigint"
    ),
    "domains": I.DOMAIN_SCHEMA,
    "pages": "url string, domain string, first_seen bigint, last_seen bigint",
    "meta": "key string, value string",
}
#: Column whose hash gives a row's part, and the order inside a part's files (reads of a domain skip by it).
KEYS = {"edges": "source_url", "domains": "domain", "pages": "url", "meta": "key"}
#: The columns that tell a table's rows apart.
IDENTITY = {**{name: [key] for name, key in KEYS.items()}, "edges": ["source_url", "target_url"]}
ORDER = {"edges": ["target_domain", "source_url"], "domains": ["domain"], "pages": ["domain", "url"], "meta": ["key"]}
#: Parts of a new index. A part is what a merge rewrites at least; ``resplit`` changes the number.
PARTS = 64
#: Rows of one file, about: a part with more is written by several tasks.
FILE_ROWS = 2_000_000
MANIFESTS, DATA = "manifests", "data"


class IndexTables:
    """Every table is split into parts by a hash of its key. A merge reads and rewrites only the parts
    that its batch touches; the manifest of a version names the folder and rows of each part.

    A manifest is created exclusively: of two writers of one version one wins. The other keeps its work
    if the winner touched none of its parts, and merges anew otherwise. Readers see the parts of one
    manifest, so either all of a merge or nothing. The manifest also holds the last batch id of each
    ``writer``, so a replayed batch changes nothing. ``vacuum`` removes what only old versions name.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path, parts
        self.files = SharedFiles(spark)

    # -------------------------------------------------------------- manifests
    def versions(self) -> list[int]:
        names = self.files.names(os.path.join(self.path, MANIFESTS))
        return sorted(int(n[1:-5]) for n in names if n.endswith(".json"))

    def _manifest_path(self, version: int) -> str:
        return os.path.join(self.path, MANIFESTS, f"v{version:012d}.json")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (default: the newest). ``tables`` maps a table's parts to
        (folder, rows)."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "parts": self.parts, "batches": {}, "tables": {name: {} for name in SCHEMAS}}
            version = known[-1]
        return json.loads(self.files.read(self._manifest_path(version)))

    # -------------------------------------------------------------- reads
    def _part(self, column: str | Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    def _rows(self, name: str, manifest: dict, parts: Iterable[int] | None = None) -> DataFrame:
        stored = manifest["tables"][name]
        wanted = stored if parts is None else [p for p in map(str, parts) if p in stored]
        paths = [os.path.join(self.path, DATA, stored[p][0], f"part={p}") for p in wanted]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name == "domains":
            # rows written before a column existed get its default
            return I.align_domains(self.spark.read.option("mergeSchema", True).parquet(*paths))
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def read(self, name: str, keys: list[str] | None = None, version: int | None = None) -> DataFrame:
        """A table of the newest or a given version. With ``keys`` only the parts are read that can hold
        these values of the table's key column, and only their rows returned."""
        manifest = self.manifest(version)
        if keys is None:
            return self._rows(name, manifest)
        given = self.spark.createDataFrame([(k,) for k in keys], "k string")
        parts = [r[0] for r in given.select(self._part("k", manifest["parts"])).distinct().collect()]
        return self._rows(name, manifest, parts).where(F.col(KEYS[name]).isin(*keys))

    # -------------------------------------------------------------- merges
    def _touched(self, keys: DataFrame, column: str, parts: int) -> dict[int, int]:
        """Rows that a batch brings to each part it touches: at most one entry per part."""
        return {r["p"]: r["n"] for r in keys.groupBy(self._part(column, parts).alias("p")).agg(F.count("*").alias("n")).collect()}

    def _placed(self, name: str, rows: DataFrame, touched: dict[int, int], base: dict, parts: int) -> DataFrame:
        """The rows shuffled by ``part`` and ``turn``. A large part's rows are spread over several tasks by a
        hash of the row's identity, so neither a large part nor a page with very many links is one task."""
        stored = base["tables"][name]
        files = [(p, 1 + (n + stored.get(str(p), ["", 0])[1]) // FILE_ROWS) for p, n in touched.items()]
        sizes = self.spark.createDataFrame(files, "part int, files long")
        placed = rows.withColumn("part", self._part(KEYS[name], parts)).join(F.broadcast(sizes), "part")
        placed = placed.withColumn("turn", F.pmod(F.xxhash64(*IDENTITY[name]), F.col("files"))).drop("files")
        return placed.repartition(max(1, sum(n for _, n in files)), "part", "turn")  # an empty batch has no files

    def _write(self, name: str, rows: DataFrame, touched: dict[int, int], base: dict, parts: int) -> dict[str, list]:
        """Write the parts; part -> [folder, rows]. Rows that come with their place are not shuffled again."""
        folder = f"{name}-{base['version']:012d}-{uuid.uuid4().hex}"
        columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        placed = rows if "turn" in rows.columns else self._placed(name, rows.select(*columns), touched, base, parts)
        placed = placed.select(*columns, "part").sortWithinPartitions("part", *ORDER[name])
        path = os.path.join(self.path, DATA, folder)
        placed.write.partitionBy("part").parquet(path)
        counts = self.spark.read.parquet(path).groupBy("part").count().collect()  # one row per touched part
        return {str(r["part"]): [folder, r["count"]] for r in counts}

    def merge(
        self, batch: DataFrame, now: int, batch_id: int | None = None, events: DataFrame | None = None, meta: DataFrame | None = None, writer: str = "",
        written: bool = False,
    ) -> int:
        """Merge edges, status events and meta values; returns the number of new edges. A batch id that
        ``writer`` has merged before changes nothing. A ``written`` batch is read from files that stay as
        they are; any other is written once here, as it is read several times."""
        base = self.manifest()
        if batch_id is not None and batch_id <= base["batches"].get(writer, -1):
            return 0
        batch = batch if written else cut_lineage(batch, "index-batch")
        addresses = cut_lineage(I.batch_addresses(batch), "index-addresses")
        events = None if events is None else cut_lineage(events, "index-events")
        meta = None if meta is None else cut_lineage(meta, "index-meta")
        while True:
            touched, written = self._merged(base, batch, addresses, now, events, meta)
            while True:
                tables = {name: {**base["tables"][name], **written[name]} for name in SCHEMAS}
                batches = base["batches"] if batch_id is None else {**base["batches"], writer: batch_id}
                out = {"version": base["version"] + 1, "parts": base["parts"], "batches": batches, "tables": tables}
                if self.files.create(self._manifest_path(out["version"]), json.dumps(out)):
                    rows = lambda m: sum(m["tables"]["edges"].get(str(p), ["", 0])[1] for p in touched["edges"])
                    return rows(out) - rows(base)
                newer = self.manifest()
                if batch_id is not None and batch_id <= newer["batches"].get(writer, -1):
                    return 0
                same = base["parts"] == newer["parts"] and all(
                    base["tables"][name].get(str(p)) == newer["tables"][name].get(str(p)) for name in SCHEMAS for p in touched[name])
                base = newer
                if not same:
                    break

    def _merged(self, base: dict, batch: DataFrame, addresses: DataFrame, now: int, events: DataFrame | None, meta: DataFrame | None) -> tuple[dict, dict]:
        """(touched parts, written parts) of every table after the batch."""
        parts = base["parts"]
        keys = {
            "edges": batch.where(I.COMPLETE).select(F.col("source").alias("source_url")),
            "domains": addresses.select("domain"),
            "pages": addresses.where("is_source").select("url"),
        }
        if events is not None:
            keys["domains"] = keys["domains"].unionByName(events.select("domain"))
        if meta is not None:
            keys["meta"] = meta.select("key")
        touched = {name: self._touched(keys[name], KEYS[name], parts) if name in keys else {} for name in SCHEMAS}
        old = {name: self._rows(name, base, touched[name]) for name in SCHEMAS}
        domains = I.add_domains(old["domains"], addresses, now)
        new = {
            "edges": I.merge_edges(old["edges"], batch, now, lambda rows: self._placed("edges", rows, touched["edges"], base, parts)),
            "domains": domains if events is None else I.fold_domain_status(domains, events),
            "pages": I.add_pages(old["pages"], addresses, now),
            "meta": old["meta"] if meta is None else I.merge_meta(old["meta"], meta),
        }
        return touched, {name: self._write(name, new[name], touched[name], base, parts) if touched[name] else {} for name in SCHEMAS}

    # -------------------------------------------------------------- upkeep
    def resplit(self, parts: int) -> bool:
        """All tables with another number of parts, as a new version; False if a merge came between."""
        base = self.manifest()
        empty = {"version": base["version"], "tables": {name: {} for name in SCHEMAS}}
        tables = {}
        for name in SCHEMAS:
            rows = self._rows(name, base)
            touched = self._touched(rows, KEYS[name], parts)
            tables[name] = self._write(name, rows, touched, empty, parts) if touched else {}
        out = {"version": base["version"] + 1, "parts": parts, "batches": base["batches"], "tables": tables}
        return self.files.create(self._manifest_path(out["version"]), json.dumps(out))

    def vacuum(self, keep: int = 2) -> int:
        """Remove the manifests before the last ``keep`` and the parts that no kept one names; returns the number
        of removed parts. Folders of writers that started from a kept version stay, finished or not."""
        kept = self.versions()[-keep:]
        if not kept:
            return 0
        live = {(folder, p) for v in kept for parts in self.manifest(v)["tables"].values() for p, (folder, _) in parts.items()}
        for version in self.versions():
            if version < kept[0]:
                self.files.remove(self._manifest_path(version))
        removed = 0
        for folder in self.files.names(os.path.join(self.path, DATA)):
            if int(folder.split("-")[1]) >= kept[0]:
                continue
            where = os.path.join(self.path, DATA, folder)
            parts = [n for n in self.files.names(where) if n.startswith("part=")]
            dead = [n for n in parts if (folder, n[5:]) not in live]
            if len(dead) == len(parts):
                self.files.remove(where)
            else:
                for n in dead:
                    self.files.remove(os.path.join(where, n))
            removed += len(dead)
        return removed
