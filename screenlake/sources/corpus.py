"""Files of a corpus: trials, patients, notes, answers, recorded exchanges, keys, digests.

A corpus is a folder with ``trials``, ``patients`` and ``notes``; readers take
all files of a kind at once and give one row for each thing in them.
"""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.functions.dates import written_date

NOTE = "array<struct<note_id:string,date:string,type:string,author_role:string,text:string>>"
SETTLEMENT = "struct<nct_id:string,patient_id:string,criterion_id:string,verdict:string,answered_by:string,answered_on:string,note:string>"
EXCHANGE = "key string, agent string, model string, system string, user string, response string, usage struct<prompt_tokens:long,completion_tokens:long>"
ROW = "struct<kind:string,resource_type:string,resource_id:string,display:string,fhir_path:string,codes:array<struct<system:string,code:string>>,value:double,unit:string,date:string>"
CASE = f"""struct<id:string,patient_id:string,nct_id:string,screening_date:string,expected:string,provenance:string,trap:string,rationale:string,
criterion_labels:array<struct<quote:string,expected:string>>,perturbations:array<struct<kind:string,description:string,affected_resource_ids:array<string>,before:array<{ROW}>,after:array<{ROW}>>>,annotators:array<string>,adjudicated_by:string>"""


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """path, name (without .json) and text of each file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows.select("path", F.regexp_replace("file", r"\.json$", "").alias("name"), "text")


def trials(spark: SparkSession, root: str) -> DataFrame:
    """nct_id, title (brief, else official, else the id), criteria_text, minimum_age, maximum_age, sex."""
    at = lambda path: F.get_json_object("text", f"$.protocolSection.{path}")
    title = F.coalesce(F.nullif(at("identificationModule.briefTitle"), F.lit("")), F.nullif(at("identificationModule.officialTitle"), F.lit("")), F.col("name"))
    eligibility = lambda x: at(f"eligibilityModule.{x}")
    return _whole(spark, f"{root}/trials/NCT*.json").select(F.col("name").alias("nct_id"), title.alias("title"), F.coalesce(eligibility("eligibilityCriteria"), F.lit("")).alias("criteria_text"), eligibility("minimumAge").alias("minimum_age"), eligibility("maximumAge").alias("maximum_age"), eligibility("sex").alias("sex"))


def trial_ids(spark: SparkSession, root: str) -> DataFrame:
    return trials(spark, root).select("nct_id").orderBy("nct_id")


def patient_ids(spark: SparkSession, root: str) -> DataFrame:
    """patient_id in order, from the index: a list of patients, or an object with one."""
    rows = _whole(spark, f"{root}/patients/index.json")
    listed = F.coalesce(F.from_json(F.get_json_object("text", "$.patients"), "array<struct<id:string>>"), F.from_json("text", "array<struct<id:string>>"))
    return rows.select(F.explode(listed).alias("p")).select(F.col("p.id").alias("patient_id")).orderBy("patient_id")


def patient_bundles(spark: SparkSession, root: str, patient_id: str | None = None) -> DataFrame:
    """bundle of each patient, or of one."""
    rows = _whole(spark, f"{root}/patients/{patient_id or '*'}.json").filter("name <> 'index'")
    return rows.select(F.col("text").alias("bundle"))


def notes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Notes as evidence (patient_id, kind, seq, display, date, source, narrative_quote, fhir_path), and problems (path, note_id, problem) of malformed files."""
    rows = _whole(spark, f"{root}/notes/*.json").withColumn("list", F.from_json("text", NOTE))
    is_list = F.ltrim("text").startswith("[") & F.col("list").isNotNull()
    not_json = rows.filter(~is_list).select("path", F.lit(None).cast("string").alias("note_id"), F.lit("no list of notes").alias("problem"))
    told = rows.filter(is_list).select("path", F.col("name").alias("patient_id"), F.explode("list").alias("n"))
    fields = ("note_id", "date", "type", "author_role", "text")
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(f"n.{f}"), F.lit(""))) == "", F.lit(f"missing {f}")) for f in fields]))
    lacking = told.select("path", F.col("n.note_id").alias("note_id"), F.explode(missing).alias("problem"))
    twice = told.groupBy("path", F.col("n.note_id").alias("note_id")).agg(F.count("*").alias("k")).filter("k > 1").select("path", "note_id", F.lit("id used twice").alias("problem"))
    found = told.select("patient_id", F.lit("note").alias("kind"), F.col("n.note_id").alias("seq"), F.col("n.type").alias("display"), written_date(F.col("n.date")).alias("date"), F.lit("narrative").alias("source"), F.col("n.text").alias("narrative_quote"), note_pointer(F.col("path"), F.col("n.note_id")).alias("fhir_path"))
    return found, not_json.union(lacking).union(twice)


def note_pointer(path: Column, note_id: Column) -> Column:
    return F.concat(path, F.lit("#"), note_id)


def pointer_parts(pointer: Column) -> Column:
    """Struct of path and note_id; null if it is no pointer. The last mark counts."""
    path, note_id = F.regexp_extract(pointer, r"^(.+)#([^#]+)$", 1), F.regexp_extract(pointer, r"^(.+)#([^#]+)$", 2)
    return F.when(note_id != "", F.struct(path.alias("path"), note_id.alias("note_id")))


def resolved(pointers: DataFrame, found: DataFrame) -> DataFrame:
    """pointers (pointer) with the text of the note that each names, null if nothing is there."""
    return pointers.join(found.select(F.col("fhir_path").alias("pointer"), F.col("narrative_quote").alias("text")), "pointer", "left")


def read_settlements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """nct_id, patient_id, criterion_id, verdict (MET or NOT_MET), answered_by, answered_on, note. A log of another schema, an unsigned answer or one that decides nothing fails the job."""
    rows = _whole(spark, path)
    tag = F.get_json_object("text", "$.schema")
    wrong = F.raise_error(F.concat(F.lit("not a settlement log: "), F.coalesce(tag, F.lit("no schema")))).cast(f"array<{SETTLEMENT}>")
    listed = F.when(tag == schema, F.from_json(F.get_json_object("text", "$.settlements"), f"array<{SETTLEMENT}>")).otherwise(wrong)
    out = rows.select(F.explode(listed).alias("s")).select("s.*").withColumn("verdict", F.upper("verdict"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad = ~F.coalesce(F.col("verdict").isin("MET", "NOT_MET"), F.lit(False)) | blank("answered_by") | blank("note") | blank("patient_id")
    return out.withColumn("verdict", F.when(bad, F.raise_error("a settlement is met or not met, signed, explained and names one patient").cast("string")).otherwise(F.col("verdict"))).withColumn("answered_on", F.to_date("answered_on"))


def write_settlements(settlements: DataFrame, path: str, schema: str) -> None:
    """One log: people's answers, a few for each screening."""
    rows = [{k: (str(v) if k == "answered_on" else v) for k, v in r.asDict().items()} for r in settlements.orderBy("nct_id", "patient_id", "criterion_id").collect()]
    _put(settlements.sparkSession, path, json.dumps({"schema": schema, "settlements": rows}, indent=2, ensure_ascii=False).encode())


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in whatever store the path names."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    """Recorded exchanges, one a line."""
    return spark.read.schema(EXCHANGE).json(path)


def write_tape(tape: DataFrame, path: str) -> None:
    """In the order of the keys over all files, so that two tapes can be compared line by line."""
    tape.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").json(path)


def show_tape(tape: DataFrame, agent: str | None = None, limit: int = 20) -> DataFrame:
    rows = tape if agent is None else tape.filter(F.col("agent") == agent)
    return rows.orderBy("key").limit(limit)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Resolved concepts (text, codes, model, nct_id); lines that are no record are left out."""
    rows = spark.read.schema("text string, codes array<struct<system:string,code:string,display:string>>, model string, nct_id string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad IS NULL AND text IS NOT NULL").drop("_bad")


def replace_store(store: DataFrame, path: str) -> None:
    """The new store takes the place of the old one when it is whole."""
    spark, fresh, old = store.sparkSession, f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    store.write.mode("overwrite").json(fresh)
    jvm = spark._jvm
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(fresh), at(path))
    fs.delete(at(old), True)


def read_key(spark: SparkSession, path: str) -> DataFrame:
    """version and the fields of each case of a key."""
    rows = _whole(spark, path)
    return rows.select(F.get_json_object("text", "$.version").alias("version"), F.explode(F.from_json(F.get_json_object("text", "$.cases"), f"array<{CASE}>")).alias("c")).select("version", "c.*").withColumnRenamed("id", "case_id")


def write_key(spark: SparkSession, key: dict, path: str, digest: str | None = None) -> None:
    """A key with sorted fields, and its digest beside it if given."""
    _put(spark, path, (json.dumps(key, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())
    if digest:
        _put(spark, f"{path}.sha256", f"{digest}  {path.rsplit('/', 1)[-1]}\n".encode())


def write_screenings(screenings: DataFrame, path: str) -> None:
    """Screenings as JSON by trial, for a viewer."""
    screenings.write.mode("overwrite").partitionBy("nct_id").json(path)


def archived_bundles(spark: SparkSession, path: str) -> DataFrame:
    """member, bundle: the bundles in zip archives, one archive a task at a time, members streamed one by one."""
    def unzip(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in sorted(x for x in z.namelist() if x.endswith(".json")):
                        yield pa.RecordBatch.from_arrays([pa.array([member]), pa.array([z.read(member).decode("utf-8", "replace")])], names=["member", "bundle"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzip, "member string, bundle string")
    return rows.filter(F.get_json_object("bundle", "$.resourceType") == "Bundle")


def digests(spark: SparkSession, root: str) -> DataFrame:
    """name (below root), sha256 of every file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = root.split(":", 1)[-1].lstrip("/").rstrip("/")
    return rows.select(F.regexp_replace(F.substring_index("path", f"{plain}/", -1), r"^/", "").alias("name"), F.sha2("content", 256).alias("sha256"))


def verify_digests(spark: SparkSession, root: str, listing: str) -> DataFrame:
    """name, state (same, changed or missing) of every file that a listing in the form of sha256sum names."""
    listed = spark.read.text(listing).filter("trim(value) <> ''").select(F.trim(F.regexp_extract("value", r"^\S+\s+(.*)$", 1)).alias("name"), F.regexp_extract("value", r"^(\S+)", 1).alias("listed"))
    now = digests(spark, root)
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("listed"), "same").otherwise("changed")
    return listed.join(now, "name", "left").select("name", state.alias("state"))


def write_digests(spark: SparkSession, root: str, listing: str) -> int:
    """The listing of all files below root, a line a file, in the order of names: text files in the folder listing, one a part of a range sort."""
    rows = digests(spark, root).withColumn("value", F.concat_ws("  ", "sha256", "name"))
    rows.repartitionByRange("name").sortWithinPartitions("name").select("value").write.mode("overwrite").text(listing)
    return spark.read.text(listing).count()


def manifest(summaries: DataFrame) -> DataFrame:
    """patients, deceased, bytes, entries, first and last visit of a corpus of bundle summaries."""
    return summaries.agg(F.count("*").alias("patients"), F.count("deceased").alias("deceased"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_entries").alias("n_entries"), F.min("first_visit").alias("first_visit"), F.max("last_visit").alias("last_visit"))
