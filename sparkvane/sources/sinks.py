"""Sinks: a directory of tables, a minimal workbook, a static page of chart data, table artifacts, and a chat store."""
import html
import io
import json
import os
import re
import sqlite3
import time
import uuid
import zipfile
from xml.sax.saxutils import escape

ARTIFACT_ROWS, SHEET_NAME, CHATS = 2000, 31, 200


def save(folder, suffix, text):
    """Write a text under a name of its own into a folder, and return the path."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex[:10]}{suffix}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def save_bytes(spark, path, data):
    """Write bytes to a path of any file system that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def write_tables(tables, folder, fmt="parquet"):
    """One table a folder; empty tables are skipped. The rows are written by the executors."""
    out = []
    for n, df in tables.items():
        if not df.isEmpty():
            df.write.mode("overwrite").format(fmt).option("header", True).save(f"{folder.rstrip('/')}/{re.sub(r'[^\w.-]+', '_', n)}")
            out.append(n)
    return out


def _cell(ref, v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'


def _letters(k):
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(tables, rows=1_048_575):
    """Bytes of an .xlsx with one sheet a table, empty tables skipped, names cut to 31 characters. `rows` is the format's own limit."""
    sheets, seen = [], set()
    for n, df in tables.items():
        body = df.limit(rows).toPandas()
        if not len(body):
            continue
        base = name = re.sub(r"[\[\]:*?/\\]", "_", n)[:SHEET_NAME]
        k = 2
        while name.lower() in seen:
            name = f"{base[:27]} ({k})"
            k += 1
        seen.add(name.lower())
        lines = [list(body.columns), *body.astype(object).values.tolist()]
        data = "".join(f'<row r="{i}">' + "".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(lines, 1))
        sheets.append((name, f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{data}</sheetData></worksheet>'))
    out = io.BytesIO()
    pkg, off = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{off}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{off}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="s{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="s{k}" Type="{off}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (_, x) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", x)
    return out.getvalue()


def feather(df):
    """Bytes of an Arrow file (Feather version 2) of a table that fits here, a record batch for each partition."""
    import pyarrow as pa

    x = df.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_file(out, x.schema) as w:
        w.write_table(x)
    return out.getvalue()


def page(specs, title="Report"):
    """A static page with each chart's spec and its data, up to the points that a scatter has at most."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for s in specs:
        rows = s.data.limit(20_000).toPandas()
        parts.append(f"<h2>{html.escape(s.title)}</h2>{rows.to_html(index=False)}<script type='application/json'>{s.to_json().replace('</', '<\\/')}</script>")
    return "".join([*parts, "</body></html>"])


def table_artifact(df):
    """A table as an artifact: its first rows in split form, and how many there are."""
    rows = df.limit(ARTIFACT_ROWS).toPandas()
    return {"id": uuid.uuid4().hex, "type": "table", "total_rows": df.count(), "data": json.loads(rows.to_json(orient="split", date_format="iso"))}


class ChatStore:
    """Chats and their messages in a small database; deleting a chat deletes its messages."""

    def __init__(self, path=":memory:"):
        self.db = sqlite3.connect(path)
        self.db.executescript(
            "PRAGMA foreign_keys = ON; CREATE TABLE IF NOT EXISTS chats (id TEXT PRIMARY KEY, title TEXT, created REAL, updated REAL, sources TEXT);"
            "CREATE TABLE IF NOT EXISTS messages (id INTEGER PRIMARY KEY, chat_id TEXT REFERENCES chats(id) ON DELETE CASCADE, role TEXT, content TEXT, artifacts TEXT, meta TEXT, created REAL);")

    def create(self, title="New chat"):
        i, now = uuid.uuid4().hex, time.time()
        with self.db:
            self.db.execute("INSERT INTO chats VALUES (?, ?, ?, ?, '[]')", (i, title, now, now))
        return i

    def add(self, chat, role, content, artifacts=(), meta=None):
        with self.db:
            self.db.execute("INSERT INTO messages (chat_id, role, content, artifacts, meta, created) VALUES (?, ?, ?, ?, ?, ?)", (chat, role, content, json.dumps(list(artifacts)), json.dumps(meta or {}), time.time()))
            self.db.execute("UPDATE chats SET updated = ? WHERE id = ?", (time.time(), chat))

    def rename(self, chat, title):
        with self.db:
            self.db.execute("UPDATE chats SET title = ? WHERE id = ?", (title, chat))

    def set_sources(self, chat, sources):
        with self.db:
            self.db.execute("UPDATE chats SET sources = ? WHERE id = ?", (json.dumps(sources), chat))

    def delete(self, chat):
        with self.db:
            self.db.execute("DELETE FROM chats WHERE id = ?", (chat,))

    def chats(self):
        return [dict(zip(("id", "title", "created", "updated", "sources"), r, strict=True)) for r in self.db.execute(f"SELECT * FROM chats ORDER BY updated DESC LIMIT {CHATS}")]

    def messages(self, chat):
        return [dict(zip(("id", "role", "content", "artifacts", "meta", "created"), r, strict=True)) for r in self.db.execute("SELECT id, role, content, artifacts, meta, created FROM messages WHERE chat_id = ? ORDER BY id", (chat,))]

    def frame(self, spark):
        """The messages as a table."""
        rows = self.db.execute("SELECT id, chat_id, role, content, artifacts, meta, created FROM messages").fetchall()
        return spark.createDataFrame(rows, "id bigint, chat_id string, role string, content string, artifacts string, meta string, created double")
