"""The quiz store: six Parquet tables in versioned folders, with appends, upserts, updates and cascading deletes.

A table's folder holds one folder a version; a change writes the next version whole, and the manifest, a small file
created last and exclusively, names the current versions. A reader sees the old state until then, a failed change leaves
only unnamed folders, and of two changes that read the same version of a table the later one starts anew. Parquet stands in for a table format here, since none is installed; on a cluster the same calls map to
its MERGE and DELETE.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.written import written

from . import practice, sets

OPTIONS = "array<struct<key:string,text:string,image:string,image_uri:string,image_uris:array<string>>>"
#: Columns of each table, its key, and the tables that lose their rows with it: (table, column that refers to the key).
TABLES = {
    "banks": ("id long, name string, created_at long, updated_at long, last_practiced_at long", ["id"], [("questions", "bank_id"), ("attempts", "bank_id"), ("reports", "bank_id")]),
    "questions": (f"id long, bank_id long, original_id int, kind string, question string, options {OPTIONS}, answer array<string>, explanation string, knowledge string, image string, image_uri string, image_uris array<string>", ["id"], [("attempts", "question_id")]),
    "attempts": ("question_id long, bank_id long, selected array<string>, is_correct boolean, answered_at long, correct_count int, wrong_count int", ["question_id"], []),
    "progress": ("bank_id long, mode string, current_index int, updated_at long", ["bank_id", "mode"], []),
    "reports": ("report_id string, bank_id long, file_name string, import_mode string, started_at long, finished_at long, total_blocks int, candidates int, accepted int, rejected int, non_question int, unsupported int, image_count int, table_count int, used_api boolean, request_count int, warnings array<string>, ledger_complete boolean", ["report_id"], [("report_records", "report_id")]),
    "report_records": ("id long, report_id string, source_ids array<string>, original_number int, raw_text string, status string, reason_code string, reason_message string, question_ids array<long>, api_attempted boolean", ["id"], []),
}
NEW_BANK = "新题库"
#: Entries of the manifest that are no tables: the newest generation of an operation.
_GENERATION = "generation of "


class Conflict(Exception):
    """Another commit changed the named tables after they were read."""


class Stale(Exception):
    """A newer operation of the same name began: the older one's results are not taken."""


def _again(change):
    """A change that starts anew, from what the tables then hold, where another commit came between; five times at most."""

    @functools.wraps(change)
    def tried(self, *args, **more):
        if self._inside:
            return change(self, *args, **more)
        self._inside = True
        try:
            for left in range(4, -1, -1):
                self._seen.clear()
                try:
                    return change(self, *args, **more)
                except Conflict:
                    if not left:
                        raise
        finally:
            self._seen.clear()
            self._inside = False

    return tried


class Store:
    """The tables under a path. clock gives epoch milliseconds; tests fix it."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] | None = None):
        import time

        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock or (lambda: int(time.time() * 1000))
        self._seen: dict[str, str | None] = {}  # the versions that a change has read
        self._inside = False
        self._fence: tuple[str, int] | None = None

    # Versions -------------------------------------------------------------------------------------------------------

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/manifest")
        return hadoop, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, patience: int = 0) -> tuple[int, dict[str, str]]:
        """(the next free number, versions by table) of the newest manifest that was written to its end.

        With patience, a newest one that is not is looked at again so often: its writer may be about to end it.
        """
        import time

        hadoop, folder, fs = self._files()
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
        for name in names:
            stream = fs.open(hadoop.Path(folder, name))
            try:
                return int(names[0].split(".")[0]) + 1, json.loads(bytes(stream.readAllBytes()))
            except ValueError:  # its writer was lost: the one before holds
                if name == names[0] and patience:
                    time.sleep(0.2)
                    return self._manifest(patience - 1)
                continue
            finally:
                stream.close()
        return int(names[0].split(".")[0]) + 1 if names else 0, {}

    def table(self, name: str) -> DataFrame:
        version = self._manifest()[1].get(name)
        self._seen.setdefault(name, version)
        schema = TABLES[name][0]
        # Columns that an older version lacks read as null.
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{version}") if version else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, DataFrame]) -> None:
        """New contents of some tables, all or none; Stale is raised, and nothing left, where `under` an outdated fence.

        The manifest's file is created exclusively. Where another commit took the number, this one goes behind it, unless
        that one changed a table which this one read before: then Conflict is raised and nothing changes.
        """
        written = {}
        for name, df in changes.items():
            version = uuid.uuid4().hex
            columns = self.spark.createDataFrame([], TABLES[name][0]).schema
            df.select(*[F.col(c.name).cast(c.dataType) if c.name in df.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in columns]).write.parquet(f"{self.path}/{name}/{version}")
            written[name] = version
        try:
            self._publish(lambda now: written)
        except Stale:
            hadoop, folder, fs = self._files()
            for name, version in written.items():
                fs.delete(hadoop.Path(f"{self.path}/{name}/{version}"), True)
            raise

    def _publish(self, added: Callable[[dict], dict]) -> dict:
        """A new manifest with what `added` makes of the newest one; what it added."""
        hadoop, folder, fs = self._files()
        while True:
            number, now = self._manifest(patience=25)
            if self._fence and int(now.get(_GENERATION + self._fence[0], 0)) != self._fence[1]:
                raise Stale(f"{self._fence[0]} {self._fence[1]}: {now.get(_GENERATION + self._fence[0])} has begun since")
            if any(now.get(name) != version for name, version in self._seen.items()):
                raise Conflict(sorted(name for name, version in self._seen.items() if now.get(name) != version))
            new = added(now)
            try:
                out = fs.create(hadoop.Path(folder, f"{number:012d}.json"), False)
            except Exception:
                if self._manifest()[0] == number:
                    raise
                continue
            out.write(bytearray(json.dumps(now | new).encode()))
            out.close()
            self._seen.clear()
            return new

    def begin(self, operation: str) -> tuple[str, int]:
        """The fence of a new operation of that name; those that began before can commit nothing under theirs."""
        name = _GENERATION + operation
        # It reads no table, so it neither conflicts with what this store has read nor forgets it.
        held, self._fence, self._seen = (self._fence, self._seen), None, {}
        try:
            return operation, int(self._publish(lambda now: {name: str(int(now.get(name, 0)) + 1)})[name])
        finally:
            self._fence, self._seen = held

    @contextmanager
    def under(self, fence: tuple[str, int]) -> Iterator[Store]:
        """Commits inside are taken only while the fence's operation is the newest of its name; else they raise Stale.

        The fence is compared in the commit itself, beside the exclusive creation of the manifest, so nothing of a stale
        operation is ever read, however long it took and from wherever the newer one began.
        """
        held, self._fence = self._fence, fence
        try:
            yield self
        finally:
            self._fence = held

    # Changes --------------------------------------------------------------------------------------------------------

    def numbered(self, name: str, rows: DataFrame, order: list[Column]) -> DataFrame:
        """rows with dense ids behind the table's highest, in the given order, and their place among themselves.

        Range partitions are sorted and written once; one number a partition reaches the driver.
        """
        top = self.table(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        made = written(rows.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
        part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
        before, base = 0, []
        for r in made.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
            base += [F.lit(r["part"]).cast("long"), F.lit(before).cast("long")]
            before += r["n"]
        place = (F.element_at(F.create_map(*base), part) if base else F.lit(0)) + at
        return made.withColumns({"id": place.cast("long") + top + 1, "place": place.cast("int")}).drop("_m")

    def replaced(self, name: str, rows: DataFrame) -> dict[str, DataFrame]:
        """Changes of an upsert: rows of the same key go, and with them what refers to them."""
        keys = TABLES[name][1]
        gone = self.table(name).join(rows.select(*keys), keys, "left_semi")
        return self.without(name, gone) | {name: self.table(name).join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)}

    def without(self, name: str, gone: DataFrame) -> dict[str, DataFrame]:
        """Changes of a delete with all that refers to the rows that go."""
        keys = TABLES[name][1]
        out = {name: self.table(name).join(gone.select(*keys), keys, "left_anti")}
        for child, column in TABLES[name][2]:
            lost = self.table(child).join(gone.select(F.col(keys[0]).alias(column)), column, "left_semi")
            for other, rows in self.without(child, lost).items():
                old = out.get(other)
                out[other] = rows if old is None else old.join(rows.select(*TABLES[other][1]), TABLES[other][1], "left_semi")
        return out

    def touch(self, bank_id: int, practiced: bool = False) -> dict[str, DataFrame]:
        """Changes of a bank's times."""
        at, own = F.lit(self.clock()).cast("long"), F.col("id") == bank_id
        banks = self.table("banks").withColumn("updated_at", F.when(own, at).otherwise(F.col("updated_at")))
        return {"banks": banks.withColumn("last_practiced_at", F.when(own & F.lit(practiced), at).otherwise(F.col("last_practiced_at")))}

    # What the application does --------------------------------------------------------------------------------------

    @_again
    def create_bank(self, name: str, questions: DataFrame | None = None, order: str = "index") -> int:
        """A new bank, with questions in one change; its id."""
        bank_id, changes = self._new_bank(name)
        if questions is not None:
            changes |= self._appended(bank_id, questions, order)[0]
        self.commit(changes)
        return bank_id

    def _new_bank(self, name: str) -> tuple[int, dict[str, DataFrame]]:
        now, banks = self.clock(), self.table("banks")
        bank_id = banks.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        bank = self.spark.createDataFrame([(bank_id, name if name.strip() else NEW_BANK, now, now, None)], TABLES["banks"][0])
        return bank_id, {"banks": banks.unionByName(bank)}

    def _appended(self, bank_id: int, questions: DataFrame, order: str) -> tuple[dict[str, DataFrame], DataFrame]:
        """Changes of an append, and (id, index) of the new questions by place."""
        made = self.numbered("questions", questions.withColumn("bank_id", F.lit(bank_id)), [F.col(order)])
        changes = {"questions": self.table("questions").unionByName(made.select(*self._own("questions", questions)), allowMissingColumns=True)}
        return changes, made.select("id", F.col("place").alias("index"))

    def _own(self, name: str, rows: DataFrame) -> list[str]:
        known = self.spark.createDataFrame([], TABLES[name][0]).columns
        return [c for c in known if c in {*rows.columns, "id", "bank_id"}]

    @_again
    def append_questions(self, bank_id: int, questions: DataFrame, order: str = "index") -> DataFrame:
        """Questions behind the bank's; their ids by place."""
        changes, ids = self._appended(bank_id, questions, order)
        if ids.head(1):
            self.commit(changes | self.touch(bank_id))
        return ids

    @_again
    def submit(self, events: DataFrame) -> None:
        """Attempts(question_id, bank_id, selected, is_correct, answered_at) counted and kept as the last ones."""
        old = self.table("attempts")
        now = practice.upserted_attempts(old, events)
        chosen = events.groupBy("question_id").agg(F.max_by("selected", "answered_at").alias("selected")).unionByName(old.join(events.select("question_id"), "question_id", "left_anti").select("question_id", "selected"))
        self.commit({"attempts": now.join(chosen, "question_id", "left")} | self._practiced(events))

    def _practiced(self, events: DataFrame) -> dict[str, DataFrame]:
        at = events.groupBy("bank_id").agg(F.max("answered_at").alias("_at"))
        banks = self.table("banks").join(at, F.col("id") == F.col("bank_id"), "left")
        return {"banks": banks.withColumns({c: F.greatest(c, "_at") for c in ("updated_at", "last_practiced_at")})}

    @_again
    def save_progress(self, rows: DataFrame) -> None:
        """Places of sequential rounds; random and wrong ones are not kept."""
        self.commit(self.replaced("progress", practice.progress_after(rows)))

    @_again
    def save_report(self, report: DataFrame, records: DataFrame, ids: DataFrame | None = None) -> None:
        """A report and its records; a report of the same id goes with its records. Places become the ids they got."""
        self.commit(self._reported(report, records, ids))

    def _reported(self, report: DataFrame, records: DataFrame, ids: DataFrame | None) -> dict[str, DataFrame]:
        changes = self.replaced("reports", report)
        kept = changes.get("report_records", self.table("report_records"))
        rows = self.numbered("report_records", records, [F.col("report_id"), F.col("order")])
        if ids is not None:
            places = rows.select("id", F.posexplode("question_indexes").alias("_n", "index"))
            got = places.join(ids.withColumnRenamed("id", "_q"), "index").groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_q"))), lambda x: x["_q"])).alias("question_ids"))
            rows = rows.drop("question_ids").join(got, "id", "left").withColumn("question_ids", F.coalesce("question_ids", F.array().cast("array<long>")))
        return changes | {"report_records": kept.unionByName(rows.select(*self._own("report_records", rows)), allowMissingColumns=True)}

    @_again
    def delete_bank(self, bank_id: int) -> DataFrame:
        """Removes a bank with all that belongs to it; returns the image paths that nothing else refers to."""
        refs = image_paths(self.table("questions"))
        orphans = sets.exclusively_owned(refs, F.col("bank_id") == bank_id, ["path"]).collect()
        changes = self.without("banks", self.table("banks").where(F.col("id") == bank_id))
        changes["progress"] = self.table("progress").where(F.col("bank_id") != bank_id)
        self.commit(changes)
        return self.spark.createDataFrame(orphans, "path string")

    @_again
    def clear(self, seed: DataFrame | None = None, name: str = "网络互联") -> None:
        """Empties all tables, then seeds them."""
        self.commit({t: self.spark.createDataFrame([], s) for t, (s, _, _) in TABLES.items()})
        self.seed(seed, name)

    @_again
    def seed(self, questions: DataFrame | None, name: str = "网络互联") -> None:
        """A first bank, only where there is none."""
        if questions is not None and not self.table("banks").head(1):
            self.create_bank(name, questions)

    @_again
    def commit_import(self, name: str, found: dict[str, DataFrame], report: DataFrame, bank_id: int | None = None) -> int:
        """A recognised document as questions of a bank (a new one if none is given) with its report; nothing stays of
        it if a step fails."""
        target, changes = (bank_id, self.touch(bank_id)) if bank_id is not None else self._new_bank(name)
        questions = found["questions"].select("index", *[c for c in ("original_id", "kind", "question", "answer", "explanation", "knowledge") if c in found["questions"].columns])
        appended, ids = self._appended(target, questions, "index")
        self.commit(changes | appended | self._reported(report.withColumn("bank_id", F.lit(target)), found["records"], ids))
        return target


def migrated_questions(rows: DataFrame, version: int) -> DataFrame:
    """Questions of an older schema version with the columns that came since: an image in 2, a list of images in 3."""
    if version < 2:
        rows = rows.withColumn("image_uri", F.lit(None).cast("string"))
    return rows.withColumn("image_uris_json", F.lit("[]")) if version < 3 else rows


def image_paths(questions: DataFrame) -> DataFrame:
    """(bank_id, path): images of stems and options, blank ones left out."""
    none = F.array().cast("array<string>")
    own = F.concat(F.array("image_uri"), F.coalesce("image_uris", none), F.flatten(F.transform(F.coalesce("options", F.array().cast(OPTIONS)), lambda o: F.concat(F.array(o["image_uri"]), F.coalesce(o["image_uris"], none)))))
    return questions.select("bank_id", F.explode(own).alias("path")).where("trim(path) <> ''").distinct()


def relocated(path: Column, old_root: str, new_root: str) -> Column:
    """A path under the old root, by its name under the new one; others stay."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(path.startswith(old_root.rstrip("/") + "/"), F.concat(F.lit(new_root.rstrip("/") + "/"), name)).otherwise(path)


def contained(path: str, root: str) -> bool:
    """Whether a path stays inside the root once its dots are resolved."""
    import posixpath

    full, root = posixpath.normpath(posixpath.join("/", path)), posixpath.normpath(root)
    return full == root or full.startswith(root.rstrip("/") + "/")


def question_rows(stored: DataFrame) -> DataFrame:
    """Stored questions with lists kept as JSON read into columns; nulls and blanks dropped, images falling back."""
    texts = lambda c: F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    fall = lambda xs, one: F.when(F.size(xs) > 0, xs).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    options = F.filter(F.coalesce(F.from_json("options_json", "array<struct<key:string,text:string,image:string,imageUri:string,imageUris:array<string>>>"), F.array().cast("array<struct<key:string,text:string,image:string,imageUri:string,imageUris:array<string>>>")), lambda o: o.isNotNull())
    shaped = F.transform(options, lambda o: F.struct(F.coalesce(o["key"], F.lit("")).alias("key"), F.coalesce(o["text"], F.lit("")).alias("text"), o["image"].alias("image"), o["imageUri"].alias("image_uri"), fall(F.filter(F.coalesce(o["imageUris"], F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")), o["imageUri"]).alias("image_uris")))
    return stored.withColumns({"options": shaped, "answer": F.array_sort(F.transform(texts("answer_json"), F.upper)), "image_uris": fall(texts("image_uris_json"), F.col("image_uri"))}).drop("options_json", "answer_json", "image_uris_json")


def stored_rows(questions: DataFrame) -> DataFrame:
    """Questions with their lists as JSON, answers upper-cased and sorted."""
    return questions.withColumns({"options_json": F.to_json("options"), "answer_json": F.to_json(F.array_sort(F.transform("answer", F.upper))), "image_uris_json": F.to_json("image_uris")}).drop("options", "answer", "image_uris")

