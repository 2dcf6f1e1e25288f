"""Results as rows, CSV, TSV, JSON and XLSX.

CSV and TSV lines are made by Spark, so ``write_delimited`` exports any size in
parallel; ``encode`` and ``xlsx`` return bytes and are bounded by limits."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile
from decimal import Decimal
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import require
from .limits import Limits

SEPARATORS = {"csv": ",", "tsv": "\t"}


def _cell(column: Column, kind: T.DataType, separator: str) -> Column:
    text = F.to_json(F.struct(column.alias("x"))).substr(6, 1 << 30) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else column.cast("string")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = text.substr(F.lit(1), F.length(text) - 1)
    if isinstance(kind, T.StringType):  # spreadsheets would run it
        text = F.when(text.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)
    special = rf'[{separator}"\t\r\n]|[^\x00-\x7F]'
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike(special), quoted).otherwise(text), F.lit(""))


def delimited_lines(df: DataFrame, style: str = "csv") -> DataFrame:
    """One column ``line``; NULL is empty, quotes only where needed."""
    require(style in SEPARATORS, "unsupported_format", "format: csv or tsv", format=style)
    separator = SEPARATORS[style]
    cells = [_cell(F.col(f"`{f.name}`"), f.dataType, separator) for f in df.schema.fields]
    return df.select(F.concat_ws(separator, *cells).alias("line"))


def header_line(names: list[str], style: str = "csv") -> str:
    separator = SEPARATORS[style]
    quote = lambda n: '"' + n.replace('"', '""') + '"' if any(c in n for c in f'{separator}"\t\r\n') or not n.isascii() else n
    return separator.join(map(quote, names))


def write_delimited(df: DataFrame, path: str, style: str = "csv") -> None:
    """Part files with CRLF line ends; the header goes into each: before the line that is
    the first of its partition. A result without rows is one file of the header."""
    lines, head = delimited_lines(df, style), header_line(df.columns, style)
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    headed = lines.select(F.when(in_partition == 0, F.concat(F.lit(head + "\r\n"), "line")).otherwise(F.col("line")).alias("line"))
    if lines.isEmpty():
        headed = df.sparkSession.createDataFrame([(head,)], "line string")
    headed.write.option("lineSep", "\r\n").text(path)


def plain(value: Any) -> Any:
    """A cell as JSON has it: decimals without trailing zeros as text, times in ISO."""
    if isinstance(value, Decimal):
        text = format(value, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_rows(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as an object with sorted keys."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("json"))


def encode(result: dict[str, Any], style: str = "json", limits: Limits | None = None, objects: bool = False) -> bytes:
    """A collected result ({columns, rows}) as JSON, CSV or TSV bytes."""
    limits = limits or Limits()
    columns, rows = result["columns"], result["rows"]
    limits.check("max_total_cells", len(rows) * max(len(columns), 1), "result_limit_exceeded", "result cells")
    if style == "json":
        shaped = [dict(zip(columns, r)) for r in rows] if objects else rows
        made = canonical_json({"columns": columns, "rows": shaped})
    else:
        require(style in SEPARATORS, "unsupported_format", "format: json, csv or tsv", format=style)
        separator = SEPARATORS[style]

        def cell(v: Any) -> str:
            if v is None:
                return ""
            p = plain(v)
            text = p if isinstance(p, str) else canonical_json(p)
            if isinstance(v, str) and text.lstrip()[:1] in ("=", "+", "@", "-"):
                text = "'" + text
            return '"' + text.replace('"', '""') + '"' if any(c in text for c in f'{separator}"\t\r\n') or not text.isascii() else text

        made = "".join(line + "\r\n" for line in [header_line(columns, style), *[separator.join(map(cell, r)) for r in rows]])
    out = made.encode("utf-8")
    limits.check("max_response_bytes", len(out), "result_limit_exceeded", "response")
    return out


def xlsx(result: dict[str, Any], limits: Limits | None = None) -> bytes:
    """A workbook of one sheet; numbers as numbers, all else as text."""
    limits = limits or Limits()
    rows = [result["columns"], *result["rows"]]
    limits.check("max_total_cells", len(rows) * max(len(result["columns"]), 1), "result_limit_exceeded", "result cells")

    def cell(v: Any) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) and abs(v) < 1e15:
            return f"<c><v>{v!r}</v></c>"
        p = plain(v)
        text = p if isinstance(p, str) else canonical_json(p)
        limits.check_bytes("max_result_cell_bytes", text, "result_limit_exceeded", "cell")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Result" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, head + text)
    limits.check("max_response_bytes", out.tell(), "result_limit_exceeded", "response")
    return out.getvalue()
