"""The viewer's bundle: a named file for each screening and trial, and an index made from the same rows.

Files are written by the tasks that have the rows, each under a passing name
first, into a folder beside the bundle; when all are there, that folder takes the
bundle's place. A task that runs twice writes the same bytes, and a run that
stops leaves the old bundle as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.plans.criteria import Observation, Presence, Protocol, Unsupported, leaves, render, unsupported_counts

INDEX = "index.json"
DISCLAIMER = "This packet is decision support for pre-screening. Eligibility is determined by the investigator."
_SAFE = r"[^A-Za-z0-9._-]"


def screening_file(nct_id: Column, patient_id: Column) -> Column:
    """The name of a screening's file; whatever a path can't hold becomes an underscore, and a digest keeps such names apart."""
    plain = F.concat_ws("--", nct_id, patient_id.cast("string"))
    safe = F.regexp_replace(plain, _SAFE, "_")
    return F.concat(F.when(safe == plain, plain).otherwise(F.concat(safe, F.lit("-"), F.substring(F.sha2(plain, 256), 1, 12))), F.lit(".json"))


def documents(packets: DataFrame, schema: str) -> DataFrame:
    """nct_id, patient_id, file and json of each screening: the packet with the missing item behind each open criterion."""
    fields = [c for c in packets.columns if c not in ("rows", "stopped_note", "caveat_note", "settlement_note", "coverage_note", "rationale_note", "verdict")]
    body = F.struct(F.lit(schema).alias("schema"), *fields, F.col("verdict").alias("decision_label"), F.col("rows").alias("criteria"), F.lit(DISCLAIMER).alias("disclaimer"))
    return packets.select("nct_id", "patient_id", screening_file(F.col("nct_id"), F.col("patient_id")).alias("file"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def entries(packets: DataFrame) -> DataFrame:
    """The rows of the index: what a queue shows of a screening, so that a cohort of any size costs one request.

    Gaps that a query would close and gaps that need a person are counted apart;
    the first of the former, else the first of all, is what blocks.
    """
    asked = F.filter("open_items", lambda x: x["fhir_query"] != "")
    first = F.coalesce(F.try_element_at(asked, F.lit(1)), F.try_element_at("open_items", F.lit(1)))
    return packets.select(
        "nct_id", "patient_id", screening_file(F.col("nct_id"), F.col("patient_id")).alias("file"), "patient_summary", "screened_on", "decision", F.col("verdict").alias("decision_label"), "blocked_by",
        "criteria_total", "criteria_resolved", F.size("open_items").alias("open_items"), F.size(asked).alias("open_retrievable"), (F.size("open_items") - F.size(asked)).alias("open_needing_a_person"),
        first["missing"].alias("blocking"), first["criterion_id"].alias("blocking_criterion_id"), F.transform("deciding", lambda r: r["criterion_id"]).alias("deciding_criterion_ids"),
        F.size("caveats").alias("approximations"), F.size("at_visit").alias("at_visit"),
    )


def trial_document(protocol: Protocol, title: str, fingerprint: str | None, schema: str) -> dict:
    """One trial's criteria as a reviewer reads them, with counts and terms."""
    unsupported, blocking = unsupported_counts(protocol)
    terms = {p.concept.text: [{"system": s, "code": c} for s, c in p.concept.codes] for c in protocol.criteria for p in leaves(c.predicate) if isinstance(p, Observation | Presence) and p.concept.codes}
    return {
        "schema": schema, "nct_id": protocol.nct_id, "title": title, "criteria_fingerprint": fingerprint,
        "counts": {
            "criteria": len(protocol.criteria), "inclusion": sum(c.kind == "inclusion" for c in protocol.criteria), "exclusion": sum(c.kind == "exclusion" for c in protocol.criteria),
            "unsupported": unsupported, "unsupported_blocking": blocking, "unsupported_at_visit": unsupported - blocking,
        },
        "criteria": [
            {"id": c.id, "kind": c.kind, "quote": c.quote, "reads": render(c.predicate), "supported": not isinstance(c.predicate, Unsupported), "settlement": getattr(c.predicate, "settlement", None)} for c in protocol.criteria
        ],
        "terminology": [{"text": t, "codes": terms[t]} for t in sorted(terms)],
    }


def _write_files(staging: str, names: list[str]):
    """Writes (file, json) rows below staging and passes on one count a task."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        store, root = fs.FileSystem.from_uri(staging)
        n = 0
        for batch in batches:
            for file, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                passing = f"{root}/.{file}.{uuid.uuid4().hex}"
                with store.open_output_stream(passing) as out:
                    out.write(text.encode() + b"\n")
                store.move(passing, f"{root}/{file}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


def _write_index(staging: str, head: str, tail: str):
    """Streams sorted entries into one file: no task or driver holds the list."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        store, root = fs.FileSystem.from_uri(staging)
        passing, n = f"{root}/.{INDEX}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(passing) as out:
            out.write(head.encode())
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    out.write((b",\n" if n else b"\n") + text.encode())
                    n += 1
            out.write(tail.encode())
        store.move(passing, f"{root}/{INDEX}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


def write_bundle(packets: DataFrame, protocols: list[Protocol], path: str, schemas: dict[str, str], titles: dict[str, str] | None = None, fingerprints: dict[str, str] | None = None) -> int:
    """Write the bundle at path (a URI of a shared file system) and return the number of screenings.

    schemas: the tags of the three kinds of documents (screening, trial, index).
    packets is read twice, so give a written table where it is dear to make.
    """
    import json

    from pyarrow import fs

    spark, titles, fingerprints = packets.sparkSession, titles or {}, fingerprints or {}
    path = path.rstrip("/")
    staging, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    store, root = fs.FileSystem.from_uri(staging)
    store.create_dir(root)
    trials = [trial_document(p, titles.get(p.nct_id, ""), fingerprints.get(p.nct_id), schemas["trial"]) for p in protocols]
    for t in trials:
        with store.open_output_stream(f"{root}/{t['nct_id']}.trial.json") as out:
            out.write(json.dumps(t, indent=2, ensure_ascii=False).encode() + b"\n")
    n = documents(packets, schemas["screening"]).select("file", "json").mapInArrow(_write_files(staging, ["file", "json"]), "n long").agg(F.sum("n")).first()[0] or 0
    listed = [{k: t[k] for k in ("nct_id", "title", "criteria_fingerprint")} | {"file": f"{t['nct_id']}.trial.json"} | {k: v for k, v in t["counts"].items() if not k.endswith("clusion")} for t in trials]
    head = f'{{"schema": {json.dumps(schemas["index"])}, "trials": {json.dumps(listed, ensure_ascii=False)}, "screenings": ['
    rows = entries(packets)
    lines = rows.select("nct_id", "patient_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json")).orderBy("nct_id", "patient_id").select("json")
    indexed = lines.coalesce(1).mapInArrow(_write_index(staging, head, f'\n], "disclaimer": {json.dumps(DISCLAIMER)}}}\n'), "n long").first()[0]
    if indexed != n:
        raise RuntimeError(f"{n} screenings were written and {indexed} indexed")
    jvm = spark._jvm
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    files.rename(at(staging), at(path))
    files.delete(at(old), True)
    return n
