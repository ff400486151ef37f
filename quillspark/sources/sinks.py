"""Sinks: append and overwrite, manifests, vector tables (SNK1-SNK6, SNK8)."""

from __future__ import annotations

import io
import itertools
import json
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import stored, unstored
from .files import files, remove


def append_jsonl(df: DataFrame, path: str) -> None:
    """SNK1: appends rows; the folder is made if it isn't there."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK2: replaces a folder of JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """SNK3: replaces a folder of CSV with header; no rows, no write."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
    return True


def flat_lists(df: DataFrame, separator: str = " | ") -> DataFrame:
    """SNK4: arrays as joined texts, for CSV."""
    return df.select(*[F.array_join(c, separator).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def manifest(df: DataFrame, path: str) -> None:
    """SNK5: a single row as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


#: Hash buckets of a new vector table.
BUCKETS = 64


def upsert_vectors(new: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """SNK6: new rows replace those of the same key, all others stay; one row a key.

    Of new rows with one key the greatest counts, by the columns in their order; rows without key are left out. The
    table lies in hash buckets of the key, and a manifest names each bucket's folder: only the buckets that new
    rows fall into are written anew, the others keep their files. The new manifest takes the next number, which
    only one writer can get: who comes second merges again with what the first has written. Readers follow the
    newest manifest, so a crash at any point leaves the old or the new table whole; what the manifest before names stays for
    readers that are still at it, and what only older ones named goes.
    """
    spark = new.sparkSession
    others = [c for c in new.columns if c != key]
    one = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_x")).select(*[F.col(key) if c == key else F.col("_x")[c].alias(c) for c in new.columns])
    while True:
        number, table = _manifest(spark, path)
        n = table["buckets"] if table else buckets
        rows = stored(one.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), "upsert")
        touched = sorted(r["_bucket"] for r in rows.select("_bucket").distinct().collect())  # at most as many as buckets
        folders = dict(table["folders"]) if table else {}
        old = [folders[str(b)] for b in touched if str(b) in folders]
        merged = rows
        if old:
            before = spark.read.schema(new.schema).parquet(*[f"{path}/{f}" for f in old])
            merged = before.join(rows.select(key), key, "left_anti").withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).unionByName(rows)
        if touched:
            name = f"data-{uuid.uuid4().hex}"
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
            folders |= {str(b): f"{name}/_bucket={b}" for b in touched}
        unstored(rows)
        if _commit(spark, path, number + 1, {"buckets": n, "folders": folders}):
            break
    _forget(spark, path, number)


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """SNK6: the newest whole state of a table, or None."""
    _, table = _manifest(spark, path)
    return spark.read.parquet(*[f"{path}/{f}" for f in table["folders"].values()]) if table and table["folders"] else None


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, at = files(spark, f"{path.rstrip('/')}/manifest-*.json")
    return sorted(int(s.getPath().getName()[9:-5]) for s in fs.globStatus(at) or [])


def _manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict | None]:
    """The number and content of a manifest, the newest one if none is named; 0 and None where there is none."""
    found = _manifests(spark, path)
    if not found:
        return 0, None
    number = number or found[-1]
    fs, at = files(spark, f"{path}/manifest-{number}.json")
    stream = fs.open(at)
    try:
        return number, json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, table: dict) -> bool:
    """Writes a manifest beside its place and moves it there; False where another writer was first."""
    fs, draft = files(spark, f"{path}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(table).encode())
    out.close()
    _, place = files(spark, f"{path}/manifest-{number}.json")
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(place).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        # without the option to overwrite, it fails where the place is taken
        context.rename(fs.makeQualified(draft), fs.makeQualified(place), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise


def _forget(spark: SparkSession, path: str, keep_from: int) -> None:
    """Deletes manifests before a number, and the folders that no later one names."""
    found = _manifests(spark, path)
    kept = {f for n in found if n >= keep_from for f in _manifest(spark, path, n)[1]["folders"].values()}
    for n in found:
        if n < keep_from:
            gone = set(_manifest(spark, path, n)[1]["folders"].values()) - kept
            remove(spark, *[f"{path}/{f}" for f in gone], f"{path}/manifest-{n}.json")


#: Sheets of a workbook and their columns.
SHEETS = {
    "chat_summary": "session_id created_at turns user_turns assistant_turns questions last_user_text",
    "turns": "session_id created_at user_message response_type suspected_conditions red_flags follow_up_question assistant_reply questions_asked max_questions",
    "candidates": "session_id model status score selected latency breakdown",
}


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """SNK8: a workbook (Office Open XML) with a sheet for each table, a header row and one row for each of its rows in their order.

    The rows stream through the driver into the file, so a workbook is as large as its format allows: 1,048,576
    rows of a sheet and 32,767 characters of a cell. More rows go on in a further sheet, and more characters in a
    further column of the same name and a number; nothing is cut.
    """
    spark = next(iter(sheets.values())).sparkSession
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
        names: list[str] = []
        for title, df in sheets.items():
            for part, rows in enumerate(_sheets(df)):
                names.append(title if not part else f"{title}_{part + 1}")
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as sheet:
                    sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    for row in rows:
                        sheet.write(("<row>" + "".join(_cell(v) for v in row) + "</row>").encode("utf-8", "replace"))
                    sheet.write(b"</sheetData></worksheet>")
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(names))) + "</Types>")
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
    fs, at = files(spark, path)
    out = fs.create(at, True)
    out.write(raw.getvalue())
    out.close()


_CELL, _ROWS = 32_767, 1_048_575


def _sheets(df: DataFrame):
    """Lists of rows of the sheets of a table; the header stands in each."""
    texts = df.select(*[F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]).toDF(*df.columns)
    wide = [c for c, t in texts.dtypes if t == "string"]
    widths = texts.agg(*[F.max(F.length(c)).alias(c) for c in wide]).first() if wide else {}
    parts = {c: max(1, -(-(widths[c] or 0) // _CELL)) for c in wide}
    columns = [F.substring(c, i * _CELL + 1, _CELL).alias(c if not i else f"{c}_{i + 1}") if c in parts and parts[c] > 1 else F.col(c) for c in df.columns for i in range(parts.get(c, 1))]
    cut = texts.select(*columns)
    rows = cut.toLocalIterator()
    first = True
    while True:
        some = itertools.islice(rows, _ROWS)
        head = next(some, None)
        if head is None and not first:
            return
        yield itertools.chain([cut.columns], [] if head is None else [head], some)
        first = False


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
