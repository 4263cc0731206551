"""Versioned tables: every write appends versions of keyed rows, the last version of a key counts.

One driver writes; a version is a number that grows with every write.  Deleted keys get a version that says so, and
functions that change one row say whether it was there, as the rows' writers need to know.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.store import latest, preview

#: Key, and the other columns with their types; all have the times of their making and of their last change.
TABLES = {
    "tasks": ("id", "preview string, entity_count int, risk string, payload string"),
    "audits": ("id", "task_id string, operation string, payload string"),
    "projects": ("id", "name string, description string, config string"),
    "rules": ("id", "project_id string, name string, kind string, pattern string, entity_type string, enabled boolean, case_sensitive boolean"),
    "jobs": ("id", "project_id string, status string, total int, processed int, failed int, payload string"),
    "settings": ("key", "value string"),
}


class Store:
    """The tables under one folder (any store that Spark writes to)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._last = spark, folder.rstrip("/"), 0

    def _schema(self, table: str) -> str:
        key, columns = TABLES[table]
        return f"{key} string, {columns}, created_at timestamp, updated_at timestamp, version bigint, deleted boolean"

    def _versions(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}"
        jvm = self.spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(path)

    def read(self, table: str) -> DataFrame:
        """The rows that there are, each in its last version."""
        rows = latest(self._versions(table), [TABLES[table][0]], ["version"])
        return rows.where("not deleted").drop("version", "deleted")

    def get(self, table: str, key: str) -> dict | None:
        row = self.read(table).where(F.col(TABLES[table][0]) == F.lit(key)).first()
        return row.asDict() if row else None

    def append(self, table: str, rows: DataFrame, deleted: bool = False) -> None:
        """One version of each row; columns that ``rows`` lacks are null, times that are null are now."""
        if not self._last:
            self._last = max([0, *(v.agg(F.max("version")).first()[0] or 0 for v in map(self._versions, TABLES))])
        self._last += 1
        names = self.spark.createDataFrame([], self._schema(table)).dtypes
        now = F.current_timestamp()
        made = {"created_at": F.coalesce(F.col("created_at"), now) if "created_at" in rows.columns else now, "updated_at": now, "version": F.lit(self._last), "deleted": F.lit(deleted)}
        columns = [made.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in names]
        rows.select(*columns).write.mode("append").parquet(f"{self.folder}/{table}")

    def put(self, table: str, **row) -> dict:
        """Insert or replace one row."""
        row = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v for k, v in row.items()}
        types = dict(f.strip().split(" ") for f in self._schema(table).split(","))
        self.append(table, self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[k]}" for k in row)))
        return self.get(table, row[TABLES[table][0]])

    def update(self, table: str, key: str, **changes) -> dict | None:
        """Change the fields that are given and not None; None where there is no such row."""
        row = self.get(table, key)
        if row is None:
            return None
        return self.put(table, **{k: v for k, v in {**row, **{k: v for k, v in changes.items() if v is not None}}.items() if k != "updated_at"})

    def delete(self, table: str, which: Column) -> int:
        """Delete rows; returns how many there were."""
        doomed = self.read(table).where(which)
        n = doomed.count()
        if n:
            self.append(table, doomed, deleted=True)
        return n

    def save_task(self, key: str, text: str, entity_count: int, risk: str, payload: dict) -> dict:
        """A task with the beginning of its text as preview."""
        head = self.spark.range(1).select(preview(F.lit(text))).first()[0]
        return self.put("tasks", id=key, preview=head, entity_count=entity_count, risk=risk, payload=payload)

    def delete_task(self, key: str) -> bool:
        """A task and its audits go; says whether there was one."""
        self.delete("audits", F.col("task_id") == key)
        return self.delete("tasks", F.col("id") == key) > 0

    def create_project(self, key: str, name: str, description: str = "", config: dict | None = None) -> dict:
        return self.put("projects", id=key, name=name, description=description, config=config or {})

    def projects(self) -> DataFrame:
        """Projects, the last changed first."""
        return self.read("projects").orderBy(F.desc("updated_at"), "id")

    def delete_project(self, key: str) -> bool:
        """A project and its rules go, its jobs stay as history."""
        self.delete("rules", F.col("project_id") == key)
        return self.delete("projects", F.col("id") == key) > 0

    def save_rule(self, key: str, name: str, kind: str, pattern: str, entity_type: str, project_id: str | None = None, enabled: bool = True, case_sensitive: bool = False) -> dict:
        from veilspark.operators.detect import java_pattern

        if kind not in ("keyword", "regex") or java_pattern({"kind": kind, "pattern": pattern, "entity_type": entity_type}) is None:
            raise ValueError("the rule cannot be used")
        return self.put("rules", id=key, project_id=project_id, name=name, kind=kind, pattern=pattern, entity_type=entity_type, enabled=enabled, case_sensitive=case_sensitive)

    def delete_rule(self, key: str) -> bool:
        return self.delete("rules", F.col("id") == key) > 0

    def create_job(self, key: str, total: int, payload: dict, project_id: str | None = None) -> dict:
        return self.put("jobs", id=key, project_id=project_id, status="queued", total=total, processed=0, failed=0, payload=payload)

    def update_job(self, key: str, status: str | None = None, processed: int | None = None, failed: int | None = None, payload: dict | None = None) -> dict | None:
        return self.update("jobs", key, status=status, processed=processed, failed=failed, payload=payload)

    def set_setting(self, key: str, value) -> None:
        self.put("settings", key=key, value=json.dumps(value, ensure_ascii=False))

    def setting(self, key: str, default=None):
        row = self.get("settings", key)
        return json.loads(row["value"]) if row else default

    def run_job(self, key: str, records: DataFrame, process, steps: int = 4) -> dict:
        """``process`` (from records to a table to append under ``results``) over the records in steps; progress is written after each.

        Records are split by a hash of file and row, so a step that fails can be run again by itself.
        """
        total = records.count()
        self.update_job(key, status="running")
        done = 0
        for step in range(steps):
            part = records.where(F.pmod(F.xxhash64("file", "row"), F.lit(steps)) == step)
            process(part).withColumn("job_id", F.lit(key)).write.mode("append").parquet(f"{self.folder}/results")
            done += part.count()
            self.update_job(key, processed=done)
        return self.update_job(key, status="completed", processed=total)
