"""Saved jobs: one JSON document to a job, read, listed, replaced and deleted as partitions of a table."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<i: int, orig_i: int, p: int, src: string, ja: string, rects_px: array<array<double>>, font_size_px: double, label: string, comment: string>"
FIGURE = "struct<url: string, caption: string, figure_number: string, kind: string, source: string>"
PAGE = f"struct<index: int, page_no: int, image_url: string, status: string, is_supplement: boolean, blocks: array<{BLOCK}>, figures: array<{FIGURE}>>"
STATE = f"id string, filename string, model string, lang string, status string, supplement_status string, created_at double, error string, total_pages int, pages array<{PAGE}>"

#: Fields of a job that are neither saved nor shown (fixed values).
RUNTIME = ("event_queue", "task", "supplement_task")
JOB_ID = re.compile(r"[A-Za-z0-9_-]{1,64}")
#: An absolute path, a drive or a step upwards in a bundle's file name.
OUTSIDE = re.compile(r"^[/\\]|:|(^|[/\\])\.\.([/\\]|$)")
MOST_BYTES = 4 << 30


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """All job documents under a path. Broken ones are left out; what was under way when they were saved is not any more."""
    raw = spark.read.schema(f"{STATE}, broken string").options(multiLine="true", mode="PERMISSIVE", columnNameOfCorruptRecord="broken").json(path)
    return settled(raw.where("broken is null and id is not null").drop("broken"))


def parse_states(rows: DataFrame, column: str) -> DataFrame:
    """A6 on a column of job documents: one row to each that can be read and has an id."""
    return settled(rows.select(F.from_json(column, STATE, {"mode": "PERMISSIVE"}).alias("s")).where("s.id is not null").select("s.*"))


def settled(jobs: DataFrame) -> DataFrame:
    """What was under way when a job was saved is not any more."""
    under_way = lambda c: F.when(F.col(c).isin("queued", "running", "processing", "cancelling"), "cancelled").otherwise(F.col(c))
    idle = F.transform("pages", lambda p: p.withField("status", F.when(p["status"] == "processing", "pending").otherwise(p["status"])))
    return jobs.withColumns({"status": under_way("status"), "supplement_status": under_way("supplement_status"), "pages": idle})


def public(jobs: DataFrame) -> DataFrame:
    """Without what only a running process needs."""
    return jobs.drop(*RUNTIME)


def listing(jobs: DataFrame) -> DataFrame:
    """Newest first, without pages; a job without a language is Japanese."""
    return jobs.select("id", "filename", "status", F.coalesce("lang", F.lit("ja")).alias("lang"), F.coalesce("created_at", F.lit(0.0)).alias("created_at")).orderBy(F.desc("created_at"), "id")


def sentences(jobs: DataFrame) -> DataFrame:
    """One row to each sentence of each page; an empty translation is null."""
    page = jobs.select(F.col("id").alias("doc_id"), F.explode("pages").alias("page"))
    block = page.select("doc_id", F.col("page.page_no").alias("page_no"), F.coalesce("page.is_supplement", F.lit(False)).alias("is_supplement"), F.explode("page.blocks").alias("b"))
    return block.select("doc_id", "page_no", "is_supplement", "b.*").withColumn("ja", F.nullif("ja", F.lit(""))).withColumnRenamed("ja", "tgt")


def replace_jobs(jobs: DataFrame, path: str) -> None:
    """Writes the jobs in place of those of the same id; the committer makes each replacement whole."""
    jobs.withColumn("job", F.col("id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").json(path)


class JobFolder:
    """A folder with a partition `job=<id>` to each job, in which jobs are replaced and deleted as a whole.

    New partitions are written aside and moved into place when all of them are complete; what they replace, and what is deleted, is first
    moved aside, then removed. A move is one rename. Whoever stops between two steps leaves jobs that are old, new or, for
    the time between two renames, absent: `recover` finishes what was complete and forgets what was not. Readers don't see what lies aside.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet") -> None:
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at(path))) if self.fs.exists(self._at(path)) else []

    def _move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self._at(target).getParent())
        if not self.fs.rename(self._at(source), self._at(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def _aside(self, name: str) -> None:
        if self.fs.exists(self._at(f"{self.path}/{name}")):
            self._move(f"{self.path}/{name}", f"{self.path}/_gone/{uuid.uuid4().hex}/{name}")

    def replace(self, jobs: DataFrame) -> None:
        """Rows (job, ...) take the place of all rows of the same jobs; other jobs stay. Rows without a job are an error."""
        if not jobs.where("job is null").isEmpty():
            raise ValueError("a row without a job")
        run = f"{self.path}/_staged/{uuid.uuid4().hex}"
        jobs.write.partitionBy("job").format(self.kind).save(run)  # its _SUCCESS file says that it is complete
        self._settle(run)
        self._purge()

    def delete(self, ids: list[str]) -> None:
        """K6: the jobs of these ids go; ids that no job has are passed over."""
        for i in ids:
            if not JOB_ID.fullmatch(i):
                raise ValueError(f"bad job id {i!r}")
            self._aside(f"job={i}")
        self._purge()

    def recover(self) -> None:
        """After a stop: complete runs are moved into place, others are removed, and so is what was moved aside."""
        for run in self._names(f"{self.path}/_staged"):
            if self.fs.exists(self._at(f"{self.path}/_staged/{run}/_SUCCESS")):
                self._settle(f"{self.path}/_staged/{run}")
        self._purge()

    def _settle(self, run: str) -> None:
        for name in self._names(run):
            if name.startswith("job="):
                self._aside(name)
                self._move(f"{run}/{name}", f"{self.path}/{name}")

    def _purge(self) -> None:
        for name in ("_staged", "_gone"):
            self.fs.delete(self._at(f"{self.path}/{name}"), True)

    def read(self, schema: str) -> DataFrame:
        """All jobs; `schema` without the partition, which comes as the column job."""
        return self.spark.read.schema(f"{schema}, job string").format(self.kind).load(self.path)


def export_bundle(state: bytes, job_id: str, files: dict[str, bytes]) -> bytes:
    """A zip with <id>/state.json and the job's files; images are stored, the rest deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{job_id}/state.json", state)
        for name, data in sorted(files.items()):
            kind = zipfile.ZIP_STORED if name.lower().endswith((".png", ".jpg", ".jpeg")) else zipfile.ZIP_DEFLATED
            z.writestr(f"{job_id}/{name}", data, kind)
    return out.getvalue()


def open_bundle(data: bytes) -> tuple[str, dict[str, bytes]]:
    """A10: the job id and files of a bundle with one state.json, at most one folder deep.

    The id is the one that the state gives, else the folder's. Files beside the folder are left out. A bundle that is too
    large, has no or several states, an unreadable one, a bad id or a path out of its folder is a ValueError.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = {i.filename: i.file_size for i in z.infolist() if not i.is_dir()}
        states = [m["folder"] or "" for m in map(re.compile(r"(?P<folder>[^/]*/)?state\.json").fullmatch, entries) if m]
        folder = states[0] if states else ""
        inside = {name.removeprefix(folder): name for name in entries if name.startswith(folder)}
        faults = {
            "too large": sum(entries.values()) > MOST_BYTES,
            f"{len(states)} state files": len(states) != 1,
            "a path leaves the folder": any(OUTSIDE.search(name) for name in inside),
        }
        if wrong := [text for text, found in faults.items() if found]:
            raise ValueError(f"bad bundle: {', '.join(wrong)}")
        files = {name: z.read(full) for name, full in inside.items()}
    saved = json.loads(files["state.json"])  # broken JSON is a ValueError too
    job_id = str((saved.get("id") if isinstance(saved, dict) else None) or folder.rstrip("/"))
    if not JOB_ID.fullmatch(job_id):
        raise ValueError(f"bad bundle: job id {job_id!r}")
    return job_id, files
