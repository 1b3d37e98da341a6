"""A data source for PDF files, one partition per file. It needs a PDF library at run time and says so without one."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "document_id string, page int, ord int, kind string, text string, width double, height double"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File):
        import hashlib
        import uuid

        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pymupdf; give blocks as a table instead") from e
        with open(partition.path, "rb") as f:
            data = f.read()
        document = str(uuid.uuid5(uuid.UUID("6f4a1c2e-9d3b-4e57-8a10-2c5f7b91d0a4"), hashlib.sha256(data).hexdigest()))
        with pymupdf.open(stream=data, filetype="pdf") as pdf:
            if pdf.needs_pass:
                raise ValueError(f"{partition.path} is encrypted")
            for number, page in enumerate(pdf, 1):
                for i, block in enumerate(page.get_text("blocks")):
                    text = block[4].strip()
                    if text:
                        yield (document, number, i, "paragraph", text, page.rect.width, page.rect.height)


class PdfSource(DataSource):
    """spark.dataSource.register(PdfSource); spark.read.format("statemesh_pdf").option("paths", "a.pdf,b.pdf").load()"""

    @classmethod
    def name(cls) -> str:
        return "statemesh_pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
