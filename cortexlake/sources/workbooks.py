"""Tables as the sheets of a workbook."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the format allows, and fills by name.
NAME, ROWS = 31, 1_048_576
FILLS = {"gray": "FFD9D9D9", "yellow": "FFFFFF99", "red": "FFFFC7CE", "green": "FFC6EFCE"}
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_LINKS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def sheet_names(names: list[str]) -> list[str]:
    """Names cut to 31 characters without those that a sheet may not have; of equal ones the later get a number."""
    out: list[str] = []
    for name in names:
        plain = "".join("_" if c in "[]:*?/\\" else c for c in name).strip("'") or "Sheet"
        k, made = 1, plain[:NAME]
        while made.lower() in (x.lower() for x in out):
            k += 1
            made = plain[: NAME - len(f"~{k}")] + f"~{k}"
        out.append(made)
    return out


def _letters(k: int) -> str:
    return (_letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def _cell(at: str, value: object, style: int) -> str:
    if value is None or value != value:
        return ""
    s = f' s="{style}"' if style else ""
    if isinstance(value, bool):
        return f'<c r="{at}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value not in (float("inf"), float("-inf")):
        return f'<c r="{at}"{s}><v>{value!r}</v></c>'
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n")
    return f'<c r="{at}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(tables: dict[str, DataFrame], order: str, style: Column | None = None) -> DataFrame:
    """``part, content``: the bytes of one workbook with a sheet for each table, rows by its column ``order``; ``style`` names a row's fill.

    Numbers stay numbers, everything else is text, nulls and NaN are empty cells. Each sheet's rows become XML in the tasks that hold
    them; a sheet has fewer than 1,048,576 rows below its header, as the format allows, more are an error. One task joins the sheets.
    """
    names, parts = sheet_names(list(tables)), None
    fills = list(FILLS)
    for k, df in enumerate(tables.values()):
        columns = df.columns
        numbered = df.withColumn("_style", style if style is not None else F.lit(None).cast("string"))
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = numbered.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())

        def lines(batches: Iterator[pd.DataFrame], k: int = k, columns: list[str] = columns) -> Iterator[pd.DataFrame]:
            for b in batches:
                styles = [fills.index(s) + 1 if s in fills else 0 for s in b["_style"]]
                values = [b[c].astype(object).where(b[c].notna(), None).tolist() for c in columns]
                xml = ["".join(_cell(f"{_letters(j)}\0", v[i], styles[i]) for j, v in enumerate(values)) for i in range(len(b))]
                yield pd.DataFrame({"sheet": k, "at": b["_part"].to_numpy(), "xml": xml})

        made = placed.mapInPandas(lines, "sheet int, at int, xml string").withColumn("place", F.monotonically_increasing_id())
        head = df.sparkSession.createDataFrame([(k, -1, "".join(_cell(f"{_letters(j)}\0", c, 0) for j, c in enumerate(columns)), -1)], "sheet int, at int, xml string, place long")
        made = head.unionByName(made)
        parts = made if parts is None else parts.unionByName(made)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, name in enumerate(names))
            book.writestr("xl/workbook.xml", f"<workbook {_MAIN} {_LINKS}><sheets>{listed}</sheets></workbook>")
            kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            links = "".join(f'<Relationship Id="rId{k + 1}" Type="{kind}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(names)))
            links += f'<Relationship Id="rId{len(names) + 1}" Type="{kind}/styles" Target="styles.xml"/>'
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
            book.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            colours = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in FILLS.values())
            formats = "".join(f'<xf numFmtId="0" fontId="0" fillId="{k + 2 if k >= 0 else 0}" borderId="0" xfId="0"{" applyFill=\"1\"" if k >= 0 else ""}/>' for k in range(-1, len(FILLS)))
            book.writestr("xl/styles.xml", f'<styleSheet {_MAIN}><fonts count="1"><font/></fonts><fills count="{len(FILLS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{colours}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(FILLS) + 1}">{formats}</cellXfs></styleSheet>')
            types = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(names)))
            types += '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
            book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
            now, row, sheet = -1, 0, None
            for b in batches:
                for k, xml in zip(b["sheet"].tolist(), b["xml"].tolist()):
                    if k != now:
                        if sheet is not None:
                            sheet.write(b"</sheetData></worksheet>")
                            sheet.close()
                        now, row, sheet = k, 0, book.open(f"xl/worksheets/sheet{k + 1}.xml", "w")
                        sheet.write(f"<worksheet {_MAIN}><sheetData>".encode())
                    row += 1
                    if row > ROWS:
                        raise ValueError(f"sheet {names[k]!r} has more rows than the format allows")
                    sheet.write(f'<row r="{row}">{xml.replace(chr(0), str(row))}</row>'.encode())
            if sheet is not None:
                sheet.write(b"</sheetData></worksheet>")
                sheet.close()
        data = out.getvalue()
        yield pd.DataFrame({"part": range(0, len(data), 1 << 24), "content": [data[lo : lo + (1 << 24)] for lo in range(0, len(data), 1 << 24)]})

    return parts.repartition(1).sortWithinPartitions("sheet", "at", "place").mapInPandas(joined, "part long, content binary")
