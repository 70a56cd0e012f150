"""What a parser returns: blocks in document order, metadata and warnings, as plain Python values."""

from __future__ import annotations

from dataclasses import dataclass, field

BLOCK = "struct<kind:string,level:int,text:string,page:int,depth:int,url:string,rows:array<array<string>>>"
DOCUMENT = f"doc_id long, path string, format string, byte_len long, page_count int, blocks array<{BLOCK}>, metadata map<string,string>, warnings array<struct<kind:string,level:string,message:string>>, is_encrypted boolean, error string"


@dataclass
class Parsed:
    blocks: list[dict] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    warnings: list[dict] = field(default_factory=list)
    page_count: int = 1
    is_encrypted: bool = False

    def add(self, kind: str, text: str = "", level: int | None = None, page: int | None = None, depth: int = 0, url: str | None = None, rows: list[list[str]] | None = None) -> None:
        self.blocks.append({"kind": kind, "level": level, "text": text, "page": page, "depth": depth, "url": url, "rows": rows})

    def table(self, rows: list[list[str]], page: int | None = None, depth: int = 0) -> None:
        """A table; its text is its cells by tabs and rows by line ends."""
        self.add("table", "\n".join("\t".join(r) for r in rows), page=page, depth=depth, rows=rows)

    def warn(self, kind: str, message: str, level: str = "warning") -> None:
        self.warnings.append({"kind": kind, "level": level, "message": message})
