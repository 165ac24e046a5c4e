"""PDF queries: every document set as a PDF of its words and read back, and what comes out in SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.sources import files, pdf

#: Words on a line, lines on a page, size of a page's first line (bold) and of the others.
WIDTH, HEIGHT, HEAD, BODY = 12, 40, 14, 10
_MAP = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 3 beginbfrange <0000> <5FFF> <0000> <6000> <BFFF> <6000> <C000> <FFFF> <C000> endbfrange endcmap"


def _shown(line: str) -> str:
    """A TJ operand: four words with their blanks a string, a step instead of a blank between strings."""
    words = line.split(" ")
    return " -300 ".join(f"<{' '.join(words[i : i + 4]).encode('utf-16-be', 'surrogatepass').hex()}>" for i in range(0, len(words), 4))


def written(lines: Iterable[str]) -> bytes:
    """A PDF file with the lines, HEIGHT a page; packed streams, two composite fonts, a page tree with inherited fonts."""
    lines = list(lines)
    sheets = [lines[i : i + HEIGHT] for i in range(0, len(lines), HEIGHT)] or [[]]
    stream = lambda data: b"<</Filter/FlateDecode/Length %d>>\nstream\n%b\nendstream" % (len(z := zlib.compress(data, 1)), z)
    font = lambda name: f"<</Type/Font/Subtype/Type0/BaseFont/{name}/Encoding/Identity-H/ToUnicode 5 0 R/DescendantFonts[<</Subtype/CIDFontType2/DW 500>>]>>".encode()
    kids = " ".join(f"{6 + 2 * i} 0 R" for i in range(len(sheets)))
    bodies = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(sheets)}/Resources<</Font<</F1 3 0 R/F2 4 0 R>>>>>>".encode(), font("Plain"), font("Plain-Bold"), stream(_MAP)]
    for i, sheet in enumerate(sheets):
        bodies.append(f"<</Type/Page/Parent 2 0 R/Contents {7 + 2 * i} 0 R>>".encode())
        rows = (f"BT /F{1 if n else 2} {BODY if n else HEAD} Tf 50 {800 - 18 * n} Td [{_shown(x)}] TJ ET" for n, x in enumerate(sheet))
        bodies.append(stream("\n".join(rows).encode()))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    out += b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(places) + 1, table, len(places) + 1, len(out))
    return bytes(out)


def _read(s: SparkSession, d: str) -> DataFrame:
    """The lines of a PDF made of each document. Documents are dealt by their id, as a file of them may be one
    partition, to more tasks than run at a time; a task sets and decodes its files one after another, so they are never a table."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lines in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([written(lines.as_py())], pa.binary())], ["doc_id", "content"])

    words = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / WIDTH).cast("int")), lambda i: F.array_join(F.slice(w, i * WIDTH + 1, WIDTH), " "))
    set_lines = F.flatten(F.transform(F.filter(words, lambda w: F.size(w) > 0), cut))
    tasks = max(4 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").repartition(tasks, "doc_id")
    return pdf.in_lines(docs.select("doc_id", set_lines.alias("lines")).mapInArrow(made, "doc_id long, content binary"))


_SET = rf"""src AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(range(len(ls))) AS li, regexp_extract_all(unnest(ls), '[^\x20\x09-\x0D]+') AS w FROM src),
    p AS (SELECT doc_id, li, unnest(range(0, len(w), {WIDTH})) AS wi, w FROM l WHERE len(w) > 0),
    n AS (SELECT doc_id, array_to_string(w[wi + 1:wi + {WIDTH}], ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY li, wi) - 1 AS k FROM p),
    placed AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(k // {HEIGHT} + 1 AS INT) AS page, k, t, k % {HEIGHT} = 0 AS head FROM n)"""

QUERIES = {
    "ingest_pdf_lines": lambda s, d: pdf.lines(_read(s, d)),
    "ingest_pdf_texts": lambda s, d: files.page_texts(pdf.pages(_read(s, d))),
}

ORACLE_SQL = {
    "ingest_pdf_lines": f"""WITH {_SET}, c AS (SELECT doc_id, page, k, head, {r.clean_line(r.DUCK, "t")} AS text FROM placed), g AS (SELECT * FROM c WHERE NOT {r.garbage_line(r.DUCK, "text")})
        SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS INT) AS line_no, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS global_idx, text, CASE WHEN head THEN {HEAD}::DOUBLE ELSE {BODY}::DOUBLE END AS font_size, head AS is_bold FROM g""",
    "ingest_pdf_texts": f"WITH {_SET}, g AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY k) AS text FROM placed GROUP BY ALL) SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM g GROUP BY doc_id",
}
